"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity
of 0.8 or more. The product is never formed whole:

1. Equal sets are one class (a digest of the set), so copies cost one row each.
2. Rows of the incidence matrix keep only a prefix: shingles in one global order, rare
   ones first, as many as any partner must share one of. The order comes from a table of
   corpus counts of fixed length; any order is right, a better one has fewer partners.
3. The block of a shingle is the documents with it in their prefix. First each block is
   multiplied with its smallest document only. Pairs whose overlap counts can still
   reach the bound that follows from both sizes are verified on their whole sets.
4. Documents that these links join need no more links among them. Blocks that still hold
   several components are multiplied between components only, and by sizes: of a pair the
   smaller set brings its first shingles, fewer than its prefix, and meets sets of its own
   and the next band of sizes. Parity signatures, overlap counts and last positions bound
   the overlap further, and what passes is verified.

Steps 3 and 4 together lose no link between different components, so components are
exact, and large groups of near copies cost no pairs within a group.

Cases. Null or empty texts, and texts without words, have no shingles and link with
nothing; a text of fewer than 5 words has its word sequence as one. Rows with equal
doc_id are one document: each has its own set, any of them links it, and all have one
component. A null doc_id takes no part: its component is null. Ties go to the smaller
doc_id. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounded_table import MARK_BITS, counted, id_keys, is_marked, marked, slot
from .common import map_batches, record, stored, with_text
from .components import components
from .wordkernel import mix, shingle_sets

#: Jaccard similarity in percent, and words of a shingle.
SIMILARITY = 80
WORDS = 5
#: Words of 64 bits in a set's parity signature. Each shingle flips one bit, so sets that
#: differ by d shingles have signatures that differ by d bits at most: a bound on overlaps.
SIGNATURE = [f"g{i}" for i in range(8)]
INCIDENCE = "doc_id long, n long, d1 long, d2 long, prefix array<long>" + "".join(f", {g} long" for g in SIGNATURE)
#: More documents than this are found by a join instead of marks.
MOST_MARKED = 1 << MARK_BITS - 2


def _all_shingles(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column("text"), WORDS)])


def _incidence(batch: pa.RecordBatch, order) -> pa.RecordBatch:
    """Size, digest and prefix of each document's set."""
    level = order.value
    n, d1, d2, prefixes, signatures = [], [], [], [], []
    bits = 64 * len(SIGNATURE)
    for s in shingle_sets(batch.column("text"), WORDS):
        n.append(len(s))
        d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
        d2.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
        rare_first = np.argsort(level[slot(s)], kind="stable")  # equal levels stay in order of their hashes
        prefixes.append(s[rare_first[: len(s) - -(-SIMILARITY * len(s) // 100) + 1]].view(np.int64))
        flips = np.bincount((s >> np.uint64(24)).astype(np.int64) % bits, minlength=bits) & 1
        signatures.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
    at = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *prefixes])
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
    return record(doc_id=batch.column("doc_id"), n=pa.array(n, pa.int64()), d1=pa.array(d1, pa.int64()), d2=pa.array(d2, pa.int64()), prefix=lists, **dict(zip(SIGNATURE, np.array(signatures).reshape(-1, len(SIGNATURE)).T.copy(), strict=True)))


def _sets(batch: pa.RecordBatch, wanted) -> pa.RecordBatch:
    """The whole sets of documents, of those that may be wanted only if marks of these are given."""
    if wanted is not None:
        batch = batch.filter(pa.array(is_marked(wanted.value, id_keys(batch.column("doc_id").to_numpy(zero_copy_only=False)))))
    return record(doc_id=batch.column("doc_id"), shingles=pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), WORDS)], pa.binary()))


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
        s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(s, t, assume_unique=True))
        keep.append(100 * common >= SIMILARITY * (len(s) + len(t) - common))
    return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _wanted_sets(pairs: DataFrame, side: str, docs: DataFrame) -> DataFrame:
    """``(side, shingles)``: the whole sets of the documents on one side of pairs, and maybe of some others."""
    ids = stored(pairs.select(F.col(side).alias("doc_id")).distinct(), "wanted")
    if ids.count() <= MOST_MARKED:
        wanted = marked(ids, lambda batch: id_keys(batch.column("doc_id").to_numpy()))
    else:  # most marks would be set
        wanted, docs = None, docs.join(ids, "doc_id", "left_semi")
    return map_batches(docs, partial(_sets, wanted=wanted), "doc_id long, shingles binary").withColumnRenamed("doc_id", side)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole sets are similar enough, stored."""
    x = _wanted_sets(pairs, "a", docs).withColumnRenamed("shingles", "x")
    y = _wanted_sets(pairs, "b", docs).withColumnRenamed("shingles", "y")
    return stored(map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), _linked, "a long, b long", column="y"), "links")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each document: its set's size and its component's smallest doc_id."""
    docs = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    known = docs.where("doc_id is not null")
    order = counted(known.select("text"), _all_shingles)
    rows = incidence(known, order)
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = _components(known, rows)
    else:
        # each row by itself, then the components of one doc_id's rows together
        known = stored(known.withColumn("row", F.monotonically_increasing_id()), "numbered")
        each = known.select(F.col("row").alias("doc_id"), "text")
        found = _components(each, incidence(each, order)).withColumnRenamed("doc_id", "row")
        found = stored(known.select("doc_id", "row").join(found, "row").drop("row"), "rows")
        least = found.groupBy("doc_id").agg(F.min("component_id").alias("b"))
        both = stored(components(found.join(least, "doc_id").select(F.col("component_id").alias("a"), "b")), "components")
        found = found.join(both, found["component_id"] == both["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("group"))
        name = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        out = found.join(name, "group").select("doc_id", "n_shingles", "component_id")
    without = map_batches(docs.where("doc_id is null"), partial(_incidence, order=order), INCIDENCE)
    return out.union(without.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long")))


def incidence(docs: DataFrame, order) -> DataFrame:
    return stored(map_batches(docs, partial(_incidence, order=order), INCIDENCE), "incidence")


def _components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The components of documents, each with a doc_id of its own, from their rows of the incidence matrix."""
    some = rows.where("n > 0")
    classes = stored(some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("prefix").alias("prefix"), *(F.any_value(g).alias(g) for g in SIGNATURE)), "classes")

    entries = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "h"))
    first = F.min(F.struct("rep", "n", "pos"))
    # stored, so that a join's large partition by a common shingle can be split
    blocks = stored(entries.groupBy("h").agg(F.count("*").alias("size"), first.alias("lead")).where("size > 1").drop("size"), "leads")
    hits = stored(entries.join(blocks, "h").select("h", "rep", "n", "pos", "lead"), "blocks")

    # each block times its smallest document; need: the least overlap of sets of such sizes
    need = lambda n, m: F.ceil(SIMILARITY * (n + m) / (100 + SIMILARITY))
    sized = lambda n, m: 100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)
    star = hits.where("rep <> lead.rep").groupBy(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).agg(
        F.count("*").alias("k"), F.max("n").alias("n"), F.max("lead.n").alias("m"), F.max("pos").alias("i"), F.max("lead.pos").alias("j"))
    # a block may have another smallest document than the next, so counts may lack some here
    star = star.where(sized(F.col("n"), F.col("m")) & (2 * F.col("k") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) >= need(F.col("n"), F.col("m"))))
    links = verified(stored(star.select("a", "b"), "pairs"), docs)
    joined = stored(components(links), "components")

    # blocks of several components, each pair of components once
    of = joined.select(F.col("node").alias("rep"), "component")
    placed = hits.select("h", "rep", "n", "pos").join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # in a block of several components the largest is not paired with itself: only the others' entries meet all
    most = F.max_by("component", F.struct("entries", -F.col("component")))
    mixed = placed.groupBy("h", "component").agg(F.count("*").alias("entries")).groupBy("h").agg(most.alias("most"), F.count("*").alias("components")).where("components > 1").drop("components")
    mixed = stored(mixed, "most")
    mixed = placed.join(mixed, "h").withColumn("minor", F.col("component") != F.col("most")).drop("most")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / SIMILARITY + 1e-4)).cast("int")
    mixed = stored(mixed.withColumn("band", band).join(classes.select("rep", *SIGNATURE), "rep"), "mixed")
    # x has the smaller set of a pair, or the smaller doc_id; its partners are in its own band of sizes or the next
    index = F.col("n") - F.ceil(2 * SIMILARITY * F.col("n") / (100 + SIMILARITY)) + 1
    side = lambda t: [F.col("h"), F.col("band"), *(F.col(x).alias(f"{t}_{x}") for x in ("component", "rep", "n", "pos", *SIGNATURE))]
    x = mixed.where(F.col("pos") < index).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    n, m, i, j = (F.col(c) for c in ("x_n", "y_n", "x_pos", "y_pos"))
    differ = sum((F.bit_count(F.col(f"x_{g}").bitwiseXOR(F.col(f"y_{g}"))) for g in SIGNATURE), F.lit(0))
    fits = ((n < m) | ((n == m) & (F.col("x_rep") < F.col("y_rep")))) & (F.col("x_component") != F.col("y_component")) & sized(n, m)
    fits = fits & (1 + F.least(n - 1 - i, m - 1 - j) + F.least(i, j) >= need(n, m)) & (differ <= n + m - 2 * need(n, m))
    pairs = [x.where(a).select(*side("x")).join(mixed.where(b).select(*side("y")), ["h", "band"]).where(fits) for a, b in (("minor", "true"), ("not minor", "minor"))]
    pairs = pairs[0].union(pairs[1]).groupBy(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).agg(F.count("*").alias("k"), F.max("x_n").alias("n"), F.max("y_n").alias("m"), F.max("x_pos").alias("i"), F.max("y_pos").alias("j"))
    pairs = stored(pairs.where(F.col("k") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) >= need(F.col("n"), F.col("m"))).select("a", "b"), "pairs")
    if not pairs.isEmpty():
        joined = stored(components(links.union(verified(pairs, docs))), "components")

    of = joined.select(F.col("node").alias("rep"), "component")
    reps = classes.select("n", "d1", "d2", "rep").join(of, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that another one of their component stands for; of rows with equal doc_id one stays."""
    gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    kept = stored(kept, "kept")
    row = F.struct(*(kept[c] for c in kept.columns))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(row, F.xxhash64("text")).alias("_row")).select("_row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(kept.columns).union(one)


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
