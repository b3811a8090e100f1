"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are split at line feeds into blank-separated tokens; tokens with a digit are variable fields (<*>) from the start. The
tree has a fixed depth: a line goes down by its number of tokens, then by its first `depth` tokens, to a leaf. In a leaf that
at least min_docs documents reach, a token that fewer than min_docs documents have at its position is a variable field too; if
at least `similar` of the positions stay constant, the line's template is what is left, otherwise the line as it is. A
template that occurs in at least min_docs documents recurs: its lines are dropped from all documents but the one with the
smallest doc_id, and, within that one, all but the first.

Scale: the leaves are counted from hashes alone, so the tokens of lines in rare leaves, nearly all, go no further; those of
the rest are one row each, never a list. Counts are combined before every shuffle, and joins on hot templates have exchanges
that adaptive execution may split. Texts
are joined back once, by a row key, and only those that lose a line are rebuilt.

Nulls stay null. Lines of under min_tokens tokens say too little for a template with fields: they are their own, exact ones,
and recur by the same rule. Lines without a token are left alone. A document whose lines all go is dropped, if
drop_empty. Rows without doc_id count as one document. Rows that repeat a doc_id are one document too: a line that the first
row keeps goes from none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

MIN_DOCS, DEPTH, SIMILAR, MIN_TOKENS = 10, 3, 0.7, 3
_BLANKS = "\t\x0b\x0c\r"


def _mask(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(doc, mark, pos, tokens, leaf) of all lines with a token; those of under min_tokens have a leaf of their own, unmasked. Each
    line is split once: the leaf is made with it, inside the generator, where no filter that is pushed down repeats it."""
    text = docs["text"].cast("string")
    split = F.transform(F.split(text, "\n"), lambda line: F.array_remove(F.split(F.translate(line, _BLANKS, " " * len(_BLANKS)), " "), ""))
    leaf = lambda t: F.when(F.size(t) >= max(1, min_tokens), F.xxhash64(F.size(t), _mask(F.slice(t, 1, depth)))).when(F.size(t) > 0, F.xxhash64(F.size(t), t, F.lit("exact")))
    rows = F.transform(split, lambda t, i: F.struct(i.alias("pos"), t.alias("tokens"), leaf(t).alias("leaf")))
    return docs.select(docs["doc_id"].cast("string").alias("doc"), F.xxhash64(text).alias("mark"), F.inline(rows)).where("leaf is not null")


def templates(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, mark, pos, template): every line whose template recurs; template is a 64-bit hash of it."""
    lines = _lines(docs, depth, min_tokens)
    reached = lines.select("doc", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    reached = materialize(reached, "leaves")
    busy = lines.join(broadcast_if_small(reached, reached.count()), "leaf", "left_semi")
    line = F.monotonically_increasing_id().alias("line")  # fixed by being written
    busy = materialize(busy.select(line, "doc", "mark", "pos", "leaf", F.xxhash64("tokens").alias("raw"), _mask(F.col("tokens")).alias("tokens")), "busy-lines")
    short = F.size("tokens") < min_tokens
    exact = busy.where(short).select("doc", "mark", "pos", F.col("raw").alias("template"))
    busy = busy.where(~short)
    # one long row a token: no row holds a leaf, and a hot leaf is as many keys as it has tokens
    variable = F.xxhash64(F.lit("<*>"))
    spots = busy.select("line", "doc", "mark", "pos", "leaf", "raw", F.posexplode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("at", "token"))
    constant = spots.where(F.col("token") != variable).select("doc", "leaf", "at", "token").distinct().groupBy("leaf", "at", "token").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    constant = materialize(constant.select("leaf", "at", "token", F.lit(True).alias("stays")), "constant")
    told = spots.join(broadcast_if_small(constant, constant.count()), ["leaf", "at", "token"], "left")
    # a line's template is a sum over its tokens, combined before the shuffle: constant ones at their places, the others as one
    part = F.xxhash64("at", F.when(F.col("stays"), F.col("token")).otherwise(variable)).cast("decimal(20,0)")
    lines = told.groupBy("line", "doc", "mark", "pos", "leaf", "raw").agg(F.sum(part).alias("general"), F.count("*").alias("n"), F.count("stays").alias("stays"))
    template = F.when(F.col("stays") >= similar * F.col("n"), F.xxhash64("leaf", "general")).otherwise(F.col("raw"))
    return lines.select("doc", "mark", "pos", template.alias("template")).unionAll(exact)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, mark, pos): the lines that go."""
    kind = docs.schema["doc_id"].dataType
    named = materialize(templates(docs, min_docs, depth, similar, min_tokens), "templates")
    order = F.struct(F.col("doc").cast(kind).alias("d"), F.col("pos").alias("p"))
    counted = named.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    first = named.groupBy("template").agg(F.min(order).alias("first"))
    recurring = materialize(counted.join(first, "template"), "recurring")
    hit = named.join(broadcast_if_small(recurring, recurring.count()), "template")
    keeps = F.col("doc").cast(kind).eqNullSafe(F.col("first.d")) & (F.col("pos") == F.col("first.p"))
    return hit.where(~keeps).select("doc", "mark", "pos")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_lines (with a token), n_dropped, text_sha256 of what stays (null texts: null)."""
    made = drop_recurring_lines(docs, drop_empty=False, counted=True, **options)
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def drop_recurring_lines(docs: DataFrame, drop_empty: bool = True, counted: bool = False, **options) -> DataFrame:
    """docs, all columns, without lines of recurring templates. counted adds n_lines and n_dropped instead of the other columns."""
    gone = materialize(dropped_lines(docs, **options), "dropped").groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))
    text, at = docs["text"].cast("string"), gone["gone"]  # columns of one side or the other, whatever their names
    joined = docs.join(gone, docs["doc_id"].cast("string").eqNullSafe(gone["doc"]) & (F.xxhash64(text) == gone["mark"]), "left")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(at, i))
    left = F.when(at.isNull(), text).otherwise(F.concat_ws("\n", kept))
    emptied = at.isNotNull() & ~F.exists(kept, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    if counted:
        n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long")  # from a line's first token to its end
        return joined.select(docs["doc_id"], left.alias("text"), F.when(text.isNull(), 0).otherwise(n).alias("n_lines"), F.when(at.isNull(), 0).otherwise(F.size(at)).cast("long").alias("n_dropped"))
    if drop_empty:
        joined = joined.where(~emptied)
    return joined.select(*(left.alias(c) if c == "text" else docs[c] for c in docs.columns))
