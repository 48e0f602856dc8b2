"""Entity resolution: blocking, matchers as expressions, clusters, canonical merge, junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import HONORIFICS, LEGAL_SUFFIX, STOPWORDS, slugify, with_label_keys
from loomgraph.operators.components import connected_components
from loomgraph.session import materialize


def label_keys(entities: DataFrame) -> DataFrame:
    """One row per distinct label with its type (the smallest) and matching keys; written, since blocking, rules and clusters all read it."""
    return materialize(with_label_keys(entities.where("label is not null and label <> ''").groupBy("label").agg(F.min("entity_type").alias("entity_type"))), "label-keys")


def full_name(tokens: Column) -> Column:
    """A person's name without leading titles."""
    return F.regexp_replace(F.array_join(tokens, " "), f"^(({'|'.join(HONORIFICS)}) )+", "")


def candidates(keys: DataFrame) -> DataFrame:
    """(l, r), l < r: labels that some rule may join.

    A rule joins labels that share a token other than a stopword, or an acronym and its
    initials. Pairs of all labels that share a token would grow with the square of a common
    token's labels, so each rule meets by a key of its own: the normal form; the singular;
    the tokens without legal endings; an acronym as the initials or as a token of another; a
    single token as a person's surname. Only spellings of one name share such a key.
    """
    kept = F.array_distinct(F.filter("toks", lambda t: ~t.isin(*STOPWORDS)))
    known = keys.withColumn("kept", kept)
    bare = F.concat_ws(" ", F.array_sort(F.array_distinct(F.array_except("toks", F.array(*[F.lit(x) for x in LEGAL_SUFFIX])))))
    rule = lambda n, key: F.struct(F.lit(n).alias("rule"), key.alias("key"))
    keyed = known.select("label", "kept", F.explode(F.array(rule(0, F.col("norm")), rule(1, F.col("sing")), rule(2, bare))).alias("k")).select("label", "kept", "k.*").where("key <> ''")
    a, b = (keyed.select("rule", "key", F.col("label").alias(x), F.col("kept").alias(f"kept_{x}")) for x in "lr")
    alike = a.join(b, ["rule", "key"]).where(F.expr("l < r and arrays_overlap(kept_l, kept_r)")).select("l", "r")
    pair = lambda df: df.where("s <> g").select(F.least("s", "g").alias("l"), F.greatest("s", "g").alias("r"))
    short = known.where("acronym").select(F.col("label").alias("s"), F.col("norm").alias("key"))
    expanded = pair(short.join(known.where(F.size("kept") >= 2).select(F.col("label").alias("g"), F.col("initials").alias("key")), "key"))
    inside = pair(short.join(known.select(F.col("label").alias("g"), F.explode("kept").alias("key")), "key"))
    single = known.where((F.size("toks") == 1) & (F.size("kept") == 1)).select(F.col("label").alias("s"), F.col("norm").alias("key"))
    person = known.where("entity_type = 'person'").select(F.col("label").alias("g"), F.substring_index(full_name(F.col("toks")), " ", -1).alias("key"))
    surnames = pair(single.join(person, "key"))
    return alike.union(expanded).union(inside).union(surnames).distinct()


def _subsequence(short: Column, long: Column) -> Column:
    return F.regexp_like(long, F.concat(F.lit("^.*"), F.array_join(F.split(short, ""), ".*"), F.lit(".*$")))


def matches(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(l, r, rule, confidence): the first rule that holds for each candidate pair."""
    side = lambda p: keys.select(*[F.col(c).alias(f"{p}_{c}") for c in keys.columns])
    both = pairs.join(side("l"), F.col("l") == F.col("l_label")).join(side("r"), F.col("r") == F.col("r_label"))
    equal = (F.col("l_norm") == F.col("r_norm")) & (F.col("l_norm") != "")
    plural = (F.col("l_norm") != F.col("r_norm")) & (F.col("l_sing") == F.col("r_sing")) & (F.col("l_sing") != "")

    def acronym(loose: bool) -> Column:
        out = F.lit(False)
        for s, g in (("l", "r"), ("r", "l")):
            short, initials = F.col(f"{s}_norm"), F.col(f"{g}_initials")
            proper = F.exists(F.split(F.col(f"{g}_label"), r"\s+"), lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}"))
            shape = F.col(f"{s}_acronym") & ~F.col(f"{g}_acronym") & (F.size(f"{g}_toks") >= 2) & proper
            near = (F.length(short) >= 3) & (short != initials) & _subsequence(short, initials) & (F.length(initials) <= F.length(short) + 3)
            out = out | (shape & (near if loose else short == initials))
        return out

    def suffix() -> Column:
        a, b = F.array_distinct("l_toks"), F.array_distinct("r_toks")
        legal = F.array(*[F.lit(x) for x in LEGAL_SUFFIX])
        one = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) > 0) & (F.size(F.array_except(F.array_except(y, x), legal)) == 0)
        return (F.size(a) > 0) & (F.size(b) > 0) & (one(a, b) | one(b, a))

    def surname() -> Column:
        out = F.lit(False)
        for s, g in (("l", "r"), ("r", "l")):
            toks = F.col(f"{g}_toks")
            full = full_name(toks)
            single = F.element_at(F.col(f"{s}_toks"), 1)
            out = out | (
                (F.col(f"{g}_entity_type") == "person") & (F.size(f"{s}_toks") == 1) & (F.length(single) >= 3)
                & full.contains(" ") & (F.substring_index(full, " ", -1) == single)
            )
        return out

    rules = [("normalized-equal", 0.95, equal), ("plural", 0.9, plural), ("acronym", 0.9, acronym(False)), ("acronym-subseq", 0.8, acronym(True)), ("legal-suffix", 0.85, suffix()), ("surname", 0.85, surname())]
    first = F.coalesce(*[F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(conf).alias("confidence"))) for name, conf, test in rules])
    return both.select("l", "r", first.alias("m")).where("m is not null").select("l", "r", "m.rule", "m.confidence")


def clusters(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(label, canonical, size) for every label; canonical is the fullest form of its cluster.

    Most tokens, then longest, then one with an upper-case letter, then the last by order.
    """
    keys = labels if "toks" in labels.columns else with_label_keys(labels.select("label").distinct())
    found = connected_components(links, "l", "r")
    member = keys.join(found, keys.label == found.node, "left").select("label", "toks", F.coalesce("component", "label").alias("cluster"))
    rank = F.struct(F.size("toks"), F.length("label"), F.col("label").rlike(r"\p{Lu}"), "label")
    best = member.groupBy("cluster").agg(F.max_by("label", rank).alias("canonical"), F.count("*").alias("size"))
    return member.join(best, "cluster").select("label", "canonical", "size")


def merge_entities(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per canonical id: what the members of each cluster say together.

    entities: (id, label, entity_type, description, confidence, provenance, doc_id).
    Type from the surest member that is no plain concept, the longest description, the
    highest confidence, provenance of the surest member that is no tag, all labels and documents.
    """
    joined = entities.join(canonical.select("label", "canonical"), "label").withColumn("new_id", slugify(F.col("canonical")))
    sure = lambda test, value: F.struct(test.cast("int"), "confidence", "id", value)
    return joined.groupBy("new_id").agg(
        F.max_by("entity_type", sure(F.col("entity_type") != "concept", "entity_type")).alias("entity_type"),
        F.max("canonical").alias("label"),
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
        F.max("confidence").alias("confidence"),
        F.max_by("provenance", sure(F.col("provenance") != "obsidian_tag", "provenance")).alias("provenance"),
        F.array_sort(F.collect_set("label")).alias("aliases"),
        F.array_sort(F.collect_set("doc_id")).alias("doc_ids"),
    )


def cluster_order(found: DataFrame) -> DataFrame:
    """(canonical, size, labels, place) of clusters, the largest first, then by the canonical label in lower case."""
    grouped = found.groupBy("canonical").agg(F.max("size").alias("size"), F.array_sort(F.collect_list("label")).alias("labels"))
    return grouped.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), F.lower("canonical"), "canonical")))  # a report's order


def fold_counts(found: DataFrame) -> DataFrame:
    """(labels, clusters, merged): how many labels there are, into how many clusters, and how many were folded away."""
    return found.agg(F.count("*").alias("labels"), F.countDistinct("canonical").alias("clusters"), (F.count("*") - F.countDistinct("canonical")).alias("merged"))


def canonicalize_graph(entities: DataFrame, edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of an extraction under canonical ids, without unlinked junk.

    Edges lose self-loops and repeats of (src, dst, type, evidence). An entity is dropped if
    it is junk and no edge that is left names it.
    """
    merged = merge_entities(entities, canonical)
    ids = entities.join(canonical.select("label", "canonical"), "label").select("id", slugify(F.col("canonical")).alias("new_id")).distinct()
    linked = rewrite_edges(edges, ids, "evidence")
    ends = linked.select(F.explode(F.array("src", "dst")).alias("new_id")).distinct().withColumn("linked", F.lit(True))
    kept = merged.join(ends, "new_id", "left").where(F.col("linked").isNotNull() | ~is_junk(id="new_id")).drop("linked")
    return kept, linked


def merge_vectors(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(new_id, embedding): of each cluster the canonical label's vector, else the surest member's that has one."""
    joined = entities.where("embedding is not null").join(canonical.select("label", "canonical"), "label").withColumn("new_id", slugify(F.col("canonical")))
    best = F.struct((F.col("label") == F.col("canonical")).cast("int"), "confidence", "id")
    return joined.groupBy("new_id").agg(F.max_by("embedding", best).alias("embedding"))


def repoint_mentions(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """Mentions of new ids (id, new_id), one for each (entity, document); the surest stays, then the first source."""
    moved = mentions.join(ids.select(F.col("id").alias("entity_id"), "new_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("new_id")
    order = Window.partitionBy("entity_id", "doc_id").orderBy(F.desc("confidence"), "source_url")
    return moved.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def rewrite_edges(edges: DataFrame, ids: DataFrame, *by: str) -> DataFrame:
    """Edges between new ids (id, new_id), without loops, one per (src, dst, edge_type, *by); the surest stays."""
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("ns")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("nd"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").withColumn("src", F.coalesce("ns", "src")).withColumn("dst", F.coalesce("nd", "dst")).drop("ns", "nd").where("src <> dst")
    order = Window.partitionBy("src", "dst", "edge_type", *by).orderBy(F.desc("confidence"), F.desc("evidence"))
    return moved.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def document_links(said: DataFrame, source: Column) -> DataFrame:
    """(src, dst, confidence): new ids that one document names, from those of `source` rows to those of later labels, without loops; the surest counts.

    said: (doc_id, label, new_id, confidence, ...). The pairs are many more than the rows and
    are made where a document's rows meet: a pair of which one id stands in one document only
    is made once, and only pairs of ids that both stand in several are shuffled.
    """
    a = said.where(source).groupBy("doc_id", F.col("new_id").alias("src")).agg(F.collect_set(F.struct("label", "confidence")).alias("said"))
    b = said.groupBy("doc_id", F.col("new_id").alias("dst")).agg(F.max("label").alias("last"))
    a, b = (materialize(x.withColumn("again", F.count("*").over(Window.partitionBy(c)) > 1), "document-links") for x, c in ((a, "src"), (b, "dst")))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        sure = F.array_max(F.transform(F.filter("said", lambda s: s["label"] < F.col("last")), lambda s: s["confidence"]))
        return y.join(x.drop("again").hint("merge"), "doc_id").where("src <> dst").select("src", "dst", sure.alias("confidence")).where("confidence is not null")

    several = pairs(a.where("again"), b.where("again")).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return pairs(a.where("not again"), b).unionByName(pairs(a.where("again"), b.where("not again"))).unionByName(several)


# What marks a label as navigation, an address or a generated slug.
ADDRESSES = ("http://", "https://", "www.", ".com", ".org", ".md", ".pdf", "vault/", "ontology.yaml")
SLUG_PREFIXES = ("concept_", "event_", "publication_", "location_", "product_", "organization_", "person_", "breed_")


def is_junk(id: str = "id", label: str = "label", kind: str = "entity_type", provenance: str = "provenance") -> Column:
    """Whether an entity without edges is not worth keeping."""
    text = F.trim(F.coalesce(label, F.lit("")))
    lower = F.lower(text)
    test = (F.coalesce(provenance, F.lit("")) == "obsidian_tag") | F.coalesce(F.col(id), F.lit("")).startswith("tag_")
    test = test | ((F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "event") & text.rlike("^(1[89]|20)[0-9]{2}$"))
    for part in ADDRESSES:
        test = test | lower.contains(part)
    slug = text.rlike(f"^({'|'.join(SLUG_PREFIXES)})") & ~text.contains(" ") & (lower == text)
    return test | slug


def unlinked(entities: DataFrame, *ends: DataFrame) -> DataFrame:
    """Entities that none of the single-column tables of linked ids has."""
    every = None
    for linked in ends:
        ids = linked.select(F.col(linked.columns[0]).alias("id"))
        every = ids if every is None else every.unionByName(ids)
    return entities if every is None else entities.join(every.distinct(), "id", "left_anti")


def bcubed(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(precision, recall, f1) of cluster assignments (item, cluster) over the items of both.

    Overlap sizes come from one aggregation by (predicted, gold) cluster, not from pairs of items.
    """
    both = predicted.select("item", F.col("cluster").alias("p")).join(gold.select("item", F.col("cluster").alias("g")), "item")
    cell = both.groupBy("p", "g").agg(F.count("*").alias("n"))
    sized = cell.withColumn("np", F.sum("n").over(Window.partitionBy("p"))).withColumn("ng", F.sum("n").over(Window.partitionBy("g")))
    mean = sized.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall"))
    filled = mean.select(F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return filled.withColumn("f1", f1).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
