"""Text expressions: normalisers, tokenizers, n-grams, gates and cleaners. All are columns from columns, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of index keys, stop words of query memories, weights of n-grams by length.
KEY_STOPWORDS = "a an and are as at be by for from i in is it me my of on or that the this to with you".split()
QUERY_STOPWORDS = "a about after again all also an and any are as be by can could do does for from give have i in is it like me more music of on or other play recommend song songs some that the this to track tracks what with you".split()
BM25_STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
NGRAM_WEIGHTS = {1: 1.0, 2: 2.6, 3: 4.0}

# Patterns of the intent cascade, in order, and of the change-of-artist detectors.
INTENTS = {
    "similarity_request": r"\b(similar|like this|more like|another one|again|same vibe|reminds me)\b",
    "explicit_entity": r"\b(song|track|artist|album|by|called|named)\b",
    "mood_or_genre": r"\b(mood|genre|vibe|workout|party|sleep|study|chill|dance|sad|happy|rock|pop|jazz|metal|rap|hip hop)\b",
}
DETECTORS = {
    "broad_discovery": r"(?i)(different artist|another artist|someone (?:else|new)|new artists?|haven'?t heard|never heard|artist i (?:haven'?t|have not|don'?t know)|by (?:a|an) (?:other|different|new)|other than|something (?:else|new|different)|discover (?:new|different|some|something))",
    "artist_explicit": r"(?i)(?:\b(?:different|another|new|other)\s+(?:artist|artists|band|bands|singer|singers|musician|musicians)\b|\b(?:artist|band|singer|musician)\s+i\s+(?:haven'?t|have not|don'?t)\b|\bsomeone\s+(?:else|new)\b|\bnot\s+(?:the\s+)?same\s+(?:artist|band|singer|musician)\b|\bby\s+(?:someone\s+(?:else|new)|(?:a|an)\s+(?:other|different|new)\s+(?:artist|band|singer|musician))\b)",
    "core_change": r"(?i)(?:\bdifferent\s+(?:artist|artists|band|bands|singer|singers|musician|musicians)\b|\banother\s+(?:artist|band|singer|musician)\b|\bsomeone\s+else\b|\bnot\s+(?:the\s+)?same\s+(?:artist|band|singer|musician)\b|\bby\s+(?:someone\s+else|(?:a|an)\s+(?:other|different)\s+(?:artist|band|singer|musician))\b)",
}
APOLOGY = r"apolog|i'?m sorry|mismatch|doesn'?t match|does not match|isn'?t a |not a (good )?match|unfortunately"
SORRY = r"(?i)\b(?:sorry|apolog(?:y|ize|ise|etic)|regret|unfortunately)\b"
SCAFFOLD = r"(?i)^\s*(final[\s_]*response|response|reply|answer|assistant|output)\s*[:：]\s*"
ERA_TOKEN, WORD_TOKEN = r"^(19|20)\d{2}s?$|^\d{1,2}s$", r"^[a-z]([a-z'&/\-]*[a-z])?$"


def normalize_text(c: Column) -> Column:
    """Lower case; everything but a-z and 0-9 is one blank; trimmed. Null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def squeeze_blanks(c: Column) -> Column:
    """Runs of white space are one blank; trimmed. Null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def words(normal: Column) -> Column:
    """Words of normalised text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def lit_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def as_values(c: Column) -> Column:
    """Normalised, non-empty values of an array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_text), lambda x: x != "")


def content_tokens(c: Column) -> Column:
    """Words that are no stop words and have three letters or a digit."""
    return F.filter(words(normalize_text(c)), lambda t: ~t.isin(QUERY_STOPWORDS) & ((F.length(t) >= 3) | t.rlike("[0-9]")))


def bm25_tokens(c: Column) -> Column:
    """Lower-case runs of two or more letters, digits and underscores that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda t: ~t.isin(BM25_STOPWORDS))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array, in order, joined by blanks."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def phrases(c: Column, most: int = 8, min_chars: int = 3) -> Column:
    """The set of n-grams up to most words with at least min_chars characters."""
    t = words(normalize_text(c))
    every = F.concat(*(ngrams(t, n) for n in range(1, most + 1)))
    return F.array_distinct(F.filter(every, lambda p: F.length(p) >= min_chars))


def weighted_ngrams(c: Column, weight: float = 1.0) -> Column:
    """Structs (ngram, weight) of content tokens; the same n-gram occurs once."""
    t = content_tokens(c)
    of = lambda n, w: F.transform(F.array_distinct(ngrams(t, n)), lambda g: F.struct(g.alias("ngram"), F.lit(w * weight).alias("weight")))
    return F.concat(*(of(n, w) for n, w in NGRAM_WEIGHTS.items()))


def key_is_valid(key: Column, tag: Column, min_chars: int = 4, tag_min_chars: int = 3) -> Column:
    """Whether a normalised value is fit as an index key; tag: whether it belongs to the tag field."""
    t = words(key)
    content = F.filter(t, lambda x: ~x.isin(KEY_STOPWORDS))
    enough = F.length(key) >= F.when(tag, tag_min_chars).otherwise(min_chars)
    single = ~key.isin(KEY_STOPWORDS) & (enough | ((F.length(key) >= 2) & key.rlike("[0-9]")))
    return F.when(F.size(t) == 0, False).when(F.size(t) == 1, single).otherwise(F.length(F.array_join(content, "")) >= min_chars)


def intent(c: Column) -> Column:
    """The first pattern of the cascade that a query has, else ambiguous."""
    q, out = normalize_text(c), F
    for name, pattern in INTENTS.items():
        out = out.when(q.rlike(pattern), name)
    return out.otherwise("ambiguous")


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether normalised text holds a non-empty normalised phrase as whole words."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def token_overlap(a: Column, b: Column) -> Column:
    """Distinct words that two normalised texts share."""
    return F.size(F.array_intersect(words(a), words(b)))


def style_bucket(c: Column, buckets: int = 8) -> Column:
    """The MD5 of a key modulo a power of two up to 16: its last hexadecimal digit decides."""
    return F.conv(F.right(F.md5(c), F.lit(1)), 16, 10).cast("int") % buckets


def release_year(*columns: Column) -> Column:
    """The first year 1900-2099 in the first column that has one, else 0."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"((?:19|20)[0-9]{2})", 1), F.lit("")) for c in columns]
    return F.coalesce(*found, F.lit("0")).cast("int")


def clean_tags(tags: Column, most: int = 8) -> Column:
    """Descriptive tags: all words are eras or words, 2 to 40 characters; the first of those equal but for case; the first most."""
    fit = F.filter(F.transform(tags, F.trim), lambda t: (F.length(t) >= 2) & (F.length(t) <= 40) & F.forall(words(F.regexp_replace(F.lower(t), r"\s+", " ")), lambda w: w.rlike(ERA_TOKEN) | w.rlike(WORD_TOKEN)))
    first = F.filter(fit, lambda t, i: ~F.exists(F.slice(fit, 1, i), lambda s: F.lower(s) == F.lower(t)))
    return F.slice(first, 1, most)


def postclean(c: Column) -> Column:
    """Without up to three leading labels, emphasis marks and quotes around the whole."""
    t = F.trim(c)
    for _ in range(3):
        t = F.trim(F.regexp_replace(t, SCAFFOLD, ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\*\*([^*\n]+)\*\*", "$1"), r"\*([^*\n]+)\*", "$1")
    quoted = (F.length(t) >= 2) & F.left(t, F.lit(1)).isin('"', "'", "“") & F.right(t, F.lit(1)).isin('"', "'", "”")
    return F.when(quoted, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def fallback_response(title: Column, artist: Column) -> Column:
    """A grounded sentence about an item."""
    name = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("this track"))
    by = F.coalesce(F.concat(F.lit(" by "), F.nullif(F.trim(artist), F.lit(""))), F.lit(""))
    return F.concat(F.lit("I think you'll really enjoy \""), name, F.lit('"'), by, F.lit(" — it lines up well with what you're looking for. Want a few more in a similar vein?"))


def item_line(key: Column, fields: dict[str, Column]) -> Column:
    """One line: the id, then every field (a list is joined before) in lower case; what is missing is empty."""
    return F.concat_ws(", ", F.concat(F.lit("track_id: "), key.cast("string")), *(F.concat(F.lit(f"{k}: "), F.lower(F.coalesce(c.cast("string"), F.lit("")))) for k, c in fields.items()))


def safe_float(c: Column) -> Column:
    """A text or number as a double; what is none, or is missing, is 0."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def strict_bool(c: Column) -> Column:
    """true or false in any case, with blanks around; anything else, null too, is an error."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t == "true", True).when(t == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


def canonical_hash(*columns: Column) -> Column:
    """The SHA-256 of the columns as JSON with sorted names and no blanks; missing ones are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def name_set(c: Column) -> Column:
    """An array of names in lower case without blanks around, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def sets_meet(a: Column, b: Column) -> Column:
    """Whether two sets of names share one; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def fields_text(values: dict[str, Column]) -> Column:
    """'field: value' lines of an item's fields, without empty ones, in lower case."""
    return F.concat_ws("\n", *(F.when(F.length(F.coalesce(v, F.lit(""))) > 0, F.concat(F.lit(f"{k}: "), F.lower(v))) for k, v in values.items()))
