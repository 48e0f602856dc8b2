"""Document fingerprints from closed syncmers, in DataFrame expressions only.

Tokens are decided by the letters on the spot, never by counting from somewhere: a run of
Latin letters ends behind each e or o and before whatever is no Latin letter; any other
character but a blank is a token of its own. Every two tokens in a row are an inner
substring (s = 2), every six a k-mer (k = 6), which holds five inner substrings. A k-mer
is chosen if the smallest hash of the five is that of the first or the last: a rule that
looks at nothing outside the k-mer, so an edit moves no anchor that it does not touch.
The fingerprint is the 128 smallest hashes of the chosen k-mers; the likeness of two is
the share, among the 128 smallest of both, of those in both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import bound_batches

#: Latin letters, as ranges: much faster than a script property.
LATIN = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u1E00-\u1EFF"
TOKEN = rf"[{LATIN}&&[^eoEO]]*+[eoEO]|[{LATIN}]+|\S"
K, S = 6, 2
#: Hashes in a fingerprint.
SIZE = 128
#: Bytes of text in a range of neighbours, ranges at most, and places sampled for each range.
RANGE_BYTES, MOST_RANGES, SAMPLED = 8 << 20, 1 << 14, 16
#: Bounds in one step of the search for a row's range.
CHUNK = 128
#: Rows equal in id and text beyond which a group is folded into one row while neighbours are found.
MANY = 10_000


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of (at, hash) of the chosen k-mers of column `text`, by token number.

    A text in which no k-mer is chosen (it has few tokens) is anchored by its tokens.
    """
    inner = K - S + 1
    smers = "_smers"
    middle = ", ".join(f"{smers}[i + {j}]" for j in range(1, inner - 1))
    parts = ", ".join(f"{smers}[i + {j}]" for j in range(0, inner, S))
    spans = f"if(size({smers}) >= {inner}, sequence(0, size({smers}) - {inner}), cast(array() as array<int>))"
    return (
        df.withColumn("_tokens", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
        .withColumn(smers, F.expr("if(size(_tokens) > 1, transform(sequence(0, size(_tokens) - 2), i -> xxhash64(_tokens[i], _tokens[i + 1])), cast(array() as array<bigint>))"))
        .withColumn("_at", F.expr(f"filter({spans}, i -> least({smers}[i], {smers}[i + {inner - 1}]) <= least({middle}))"))
        .withColumn(
            out,
            F.expr(
                f"if(size(_at) > 0, transform(_at, i -> named_struct('at', i, 'hash', xxhash64({parts}))),"
                " transform(_tokens, (t, i) -> named_struct('at', i, 'hash', xxhash64(t))))"
            ),
        )
        .drop("_tokens", smers, "_at")
    )


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the SIZE smallest distinct 31-bit anchor hashes of column `text`, in order."""
    return (
        with_anchors(df, text, "_anchors")
        .withColumn("_hashes", F.expr("array_distinct(transform(_anchors, a -> int(shiftrightunsigned(a.hash, 33))))"))
        .withColumn(out, F.slice(F.sort_array("_hashes"), 1, SIZE))
        .drop("_anchors", "_hashes")
    )


def as_text(sketch: str) -> Column:
    """A sketch as eight lowercase hexadecimal digits for each hash."""
    return F.expr(f"lower(array_join(transform({sketch}, x -> lpad(hex(x), 8, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """Estimated share of common anchors, 0 to 1; 1 if neither has any."""
    merged = f"slice(sort_array(array_union({a}, {b})), 1, {SIZE})"
    return F.expr(
        f"if({a} = {b}, 1D, if(size({a}) = 0 or size({b}) = 0, 0D,"
        f" size(array_intersect(array_intersect({a}, {b}), {merged})) / double(least(size(array_union({a}, {b})), {SIZE}))))"
    )


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `fingerprint` (string). Null texts count as empty: an empty fingerprint."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    made = with_sketch(docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text")), "_text", "_sketch")
    return made.select(*keep, as_text("_sketch").alias("fingerprint"))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, at, hash) per anchor: the input of positional matching."""
    made = with_anchors(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")), "_text", "_anchors")
    # outer: else Spark infers a filter on the array's size and pushes all that it is made of into it, once for each use
    return made.select(id_col, F.explode_outer("_anchors").alias("_a")).where("_a is not null").select(id_col, "_a.at", "_a.hash")


def _bounds(keyed: DataFrame, total: int) -> list[str] | None:
    """Two JSON arrays of (id, hash) that cut the rows into ranges of about equal bytes; None for one range.

    Places are sampled by a hash, in proportion to their bytes; every SAMPLED-th is a bound.
    """
    ranges = min(MOST_RANGES, math.ceil(total / RANGE_BYTES))
    if ranges < 2:
        return None
    share = F.least(F.lit(1.0), F.col("_bytes") * (SAMPLED * ranges / total))
    u = F.pmod(F.xxhash64("_id", "_h", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    numbered = keyed.where(u < share).select(F.struct("_id", "_h").alias("b")).withColumn("n", F.row_number().over(Window.orderBy("b")))
    every = numbered.where(F.col("n") % SAMPLED == 0).select("b", F.floor((F.col("n") / SAMPLED - 1) / CHUNK).alias("c"))
    chunks = every.groupBy("c").agg(F.sort_array(F.collect_set("b")).alias("bs")).agg(F.sort_array(F.collect_list("bs")).alias("all"))
    found = chunks.select(F.to_json(F.transform("all", lambda bs: bs[0])), F.to_json("all"), F.size("all")).first()
    return [found[0], found[1]] if found[2] else None


def with_next(rows: DataFrame, id_col: str, text_col: str, carried: dict[str, str]) -> DataFrame:
    """Adds columns of the next row in order of (id, hash of the text), the first row's after the last.

    carried: column to name of its next. Rows are cut into ranges of about equal bytes, and
    the first row of each range also goes, as a sentinel, to the end of the range before, so
    that a window over one range at a time finds every next row. Ids of any type that has an
    order are compared as they are; nulls come first. One id with many texts is cut as well;
    MANY rows equal in both are folded into one, as each but the last is followed by its like.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_id", F.col(id_col)).withColumn("_h", F.xxhash64(text_col)).withColumn("_bytes", F.octet_length(text_col).cast("long") + 1)
    kind = rows.schema[id_col].dataType.simpleString()
    total = keyed.agg(F.sum("_bytes")).first()[0] or 0
    bounds = _bounds(keyed, total)
    if bounds is None:
        place = F.lit(0).cast("long")
    else:
        bound = f"struct<_id:{kind},_h:bigint>"
        heads = f"from_json('{_quoted(bounds[0])}', 'array<{bound}>')"
        chunks = f"from_json('{_quoted(bounds[1])}', 'array<array<{bound}>>')"
        key = "named_struct('_id', _id, '_h', _h)"
        keyed = keyed.withColumn("_c", F.expr(f"size(filter({heads}, b -> b <= {key}))"))
        place = F.expr(f"if(_c = 0, 0L, (_c - 1L) * {CHUNK} + size(filter(element_at({chunks}, _c), b -> b <= {key})))")
    keyed = keyed.withColumn("_range", place).drop("_c", "_bytes")

    first = keyed.groupBy("_range").agg(F.min(F.struct("_id", "_h")).alias("k")).orderBy("_range").collect()  # a row for each range
    if not first:
        return rows.select("*", *(F.col(c).alias(n) for c, n in carried.items()))
    before = [(r.k["_id"], r.k["_h"], first[i - 1]["_range"]) for i, r in enumerate(first)]  # of the first range: the last
    sentinels = spark.createDataFrame(before, f"_sid {kind}, _sh long, _before long")
    many = keyed.groupBy("_id", "_h").count().where(F.col("count") > MANY).select("_id", "_h", F.col("count").alias("_copies"))
    crowds = many.count()
    if crowds:
        full = many.select(F.col("_id").alias("_cid"), F.col("_h").alias("_ch"), "_copies")
        same = F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_h") == F.col("_ch"))
        others = [c for c in keyed.columns if c not in ("_id", "_h")]
        one = keyed.join(full, same).groupBy("_id", "_h", "_copies").agg(*(F.first(c).alias(c) for c in others))
        keyed = keyed.join(full, same, "left_anti").withColumn("_copies", F.lit(1).cast("long")).unionByName(one)
    copies = F.expr("if(_before is null, array(named_struct('r', _range, 's', 0)), array(named_struct('r', _range, 's', 0), named_struct('r', _before, 's', 1)))")
    placed = (
        keyed.join(F.broadcast(sentinels), F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_h") == F.col("_sh")), "left")
        .withColumn("_place", F.explode(copies))
        .withColumn("_range", F.col("_place.r"))
        .withColumn("_sentinel", F.col("_place.s"))
    )
    order = Window.partitionBy("_range").orderBy("_sentinel", "_id", "_h")
    for column, name in carried.items():
        placed = placed.withColumn(name, F.lead(column).over(order))
    placed = placed.where("_sentinel = 0").drop("_id", "_h", "_sid", "_sh", "_before", "_place", "_range", "_sentinel")
    if crowds:
        placed = placed.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
        for column, name in carried.items():
            placed = placed.withColumn(name, F.when(F.col("_copy") == 1, F.col(name)).otherwise(F.col(column)))
        placed = placed.drop("_copy", "_copies")
    return placed


def _quoted(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("'", "\\'")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last floor(n/4) code points replaced by the first as many
    (or all) of the next document's text. Null texts count as empty. Rows with equal ids
    are ordered by a hash of their texts; a table of one row is its own next. Ids may be of
    any type with an order. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    made = with_sketch(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")), "_text", "_sketch")
    there = with_next(made, id_col, "_text", {"_text": "_next_text", "_sketch": "_next_sketch"})
    there = there.withColumn("n_chars", F.length("_text").cast("long"))
    cut = F.expr("int(n_chars div 4)")
    there = there.withColumn("_edited", F.concat(F.expr("substring(_text, 1, int(n_chars - n_chars div 4))"), F.substring(F.col("_next_text"), F.lit(1), cut)))
    there = with_sketch(there.drop("_next_text", "_text"), "_edited", "_edited_sketch")
    return there.select(
        id_col,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text("_sketch").alias("fingerprint"),
        as_text("_edited_sketch").alias("edited_fingerprint"),
        likeness("_sketch", "_edited_sketch").alias("near_edited"),
        likeness("_sketch", "_next_sketch").alias("near_next"),
    )
