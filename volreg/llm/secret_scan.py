"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Candidates are the spans of three fixed patterns and, besides, long mixed tokens without a
known form. The hash of each candidate's value is counted over the distinct repositories
and owners that hold it: a value of many owners, or of many repositories whoever owns
them, is a widely copied example; one of few of both looks live. Long mixed tokens count
as spans (kind ``owned``) only if they look live and a single owner has them.

Positions need no Python: the texts between a pattern's matches, from ``split``, and the
matches themselves, in turn, make up the whole text, so their lengths add up to spans.

Cases. A null or empty text has no spans. Rows with equal doc_id are judged each for
itself, and count once for each repository and owner. A null repository or owner counts
as one of empty name. A null doc_id is handed on. Tables without rows give none. Spans
that start at one place are ordered by kind. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The patterns of the contract; letters of ``assign``'s words in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Long mixed tokens: judged by their owners alone.
MIXED = "[A-Za-z0-9_-]+"
#: What a text must have for a pattern to be worth a search; each is implied by a kept match.
SIGNS = {"assign": r"[DdTtNnYy][\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "mixed": "[A-Za-z0-9_-]{24}"}
KINDS = ["assign", "access", "hex", "owned"]

#: A value of at most so many owners and repositories looks live; one of more of either is an example.
MAX_LIVE_OWNERS = 2
MAX_LIVE_REPOSITORIES = 10
#: Matches that are walked in one go, and code points of a text that are cut in one go.
CHUNK = 64
BLOCK = 1 << 15


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, kind: int, sign: str, pattern: str, value_group: int, keep) -> Column:
    """Array of (start, kind, end, hash) of the matches whose value passes ``keep``.

    Matches are walked in chunks, each from its own zero, and moved to where the chunks
    before them end: an array that grows by one is copied within a chunk only, so time
    follows the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), whole.alias("m"), values.alias("v"))
    spans = "array<struct<start int, kind int, end int, hash binary>>"

    def add(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.unhex(F.md5(x["v"])).alias("hash"))
        kept = x["m"].isNotNull() & keep(x["v"])
        return F.struct(end.alias("at"), F.when(kept, F.concat(so_far["spans"], F.array(found))).otherwise(so_far["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))
    chunks = _bound(parts, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(all_, c * CHUNK + 1, CHUNK), start, add)))

    def moved(walked: Column) -> Column:
        before = lambda c: F.aggregate(F.slice(walked, 1, c), F.lit(0), lambda n, w: n + w["at"])
        by = lambda w, n: F.transform(w["spans"], lambda x: F.struct((x["start"] + n).alias("start"), x["kind"].alias("kind"), (x["end"] + n).alias("end"), x["hash"].alias("hash")))
        return F.flatten(F.transform(walked, lambda w, c: F.when(F.size(w["spans"]) > 0, _bound(before(c), lambda n: by(w, n))).otherwise(w["spans"])))

    return F.when(text.rlike(sign), _bound(chunks, moved)).otherwise(F.array().cast(spans))


def _mixed(value: Column) -> Column:
    return (F.length(value) >= 24) & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``extra``: arrays of (start, kind, end, hash); some of ``extra`` may overlap ``base``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        _spans(text, 0, SIGNS["assign"], ASSIGN, 2, lambda v: F.length(v) >= 6),
        _spans(text, 1, SIGNS["access"], ACCESS, 0, lambda v: F.length(v) >= 20),
        _spans(text, 2, SIGNS["hex"], HEX, 0, lambda v: F.length(v) >= 24),
    )
    return docs.withColumn("base", F.array_sort(base)).withColumn("extra", _spans(text, 3, SIGNS["mixed"], MIXED, 0, _mixed))


def entries(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """``(row, repository, owner, c, hash)`` of each candidate, stored; mixed tokens that overlap a base span are left out.

    Overlaps show in one walk over a row's candidates by start: the furthest end of the
    base spans before, and the next one's start.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = lambda f, c: f.select("row", name(repository), name(owner), F.explode(c).alias("c"))
    order = Window.partitionBy("row").orderBy("c.start", "c.kind", "c.end")
    begins, ends = (F.when(F.col("c.kind") < 3, F.col(f"c.{x}")) for x in ("start", "end"))
    mixed = each(found.where("size(extra) > 0"), F.concat("base", "extra")).withColumns({"begins": begins, "ends": ends})
    mixed = mixed.withColumn("reached", F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    mixed = mixed.withColumn("next", F.expr("lead(begins) ignore nulls over (partition by row order by c.start, c.kind, c.end)"))
    clear = (F.coalesce("reached", F.lit(-1)) <= F.col("c.start")) & (F.col("next").isNull() | (F.col("next") >= F.col("c.end")))
    mixed = mixed.where((F.col("c.kind") < 3) | clear).drop("begins", "ends", "reached", "next")
    both = each(found.where("size(extra) = 0"), F.col("base")).union(mixed)
    return stored(both.withColumn("hash", F.col("c.hash")), "entries")


def ownership(held: DataFrame, repository: str, owner: str) -> DataFrame:
    """For each value's hash: how many distinct repositories and owners hold it."""
    # each distinct holder once, summed in the map tasks before the shuffle
    owners = held.groupBy("hash", owner, repository).agg(F.lit(1).alias("one")).groupBy("hash", owner).agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """For each ``row`` with candidates: those that look live, and counts."""
    each = entries(found, repository, owner)
    # stored, so that the partition of a value that very many texts hold can be split
    stats = stored(ownership(each, repository, owner), "owners")
    live = (F.col("n_owners") <= MAX_LIVE_OWNERS) & (F.col("n_repositories") <= MAX_LIVE_REPOSITORIES)
    owned = live & (F.col("n_owners") == 1)
    base = F.col("c.kind") < 3
    # a struct's fields in order of the sort: the start, then the kind
    return each.select("row", "c", "hash").join(stats, "hash").groupBy("row").agg(
        F.count(F.when(base & live, 1)).alias("n_live"),
        F.count(F.when(base & ~live, 1)).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
        F.array_sort(F.collect_list(F.when(~base & owned, F.col("c")))).alias("owned"),
        F.array_sort(F.collect_list(F.when((base & live) | owned, F.col("c")))).alias("live"),
    )


def _joined(spans: Column) -> Column:
    name = lambda x: F.when(x["kind"] == 0, KINDS[0]).when(x["kind"] == 1, KINDS[1]).when(x["kind"] == 2, KINDS[2]).otherwise(KINDS[3])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


COUNTS = ["n_live", "n_example", "most_owners", "most_repositories"]


def secret_spans(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row for each document: counts by kind, digest of the base spans, all spans, and of the values' owners and repositories the most."""
    found = candidates(docs.select("doc_id", "text", repository.alias("repository"), owner.alias("owner"))).drop("text")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = found.where("size(base) + size(extra) > 0")
    verdict = judged(some, "repository", "owner")
    with_ = some.join(verdict, "row").select("doc_id", "base", F.concat("base", "owned").alias("spans"), *COUNTS)
    without = found.where("size(base) + size(extra) = 0").select("doc_id", "base", F.col("base").alias("spans"), *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return with_.union(without).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort("spans")).alias("spans"), *COUNTS)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each of the sorted spans (start, end) masked; one that begins inside another adds no mask of its own.

    Substrings count code points from a text's start, so the text is cut into blocks once
    and each block's pieces are taken from it.
    """
    step = "struct<at: int, upto: int, mask: string>"

    def add(so_far: Column, x: Column) -> Column:
        piece = F.struct(so_far["at"].alias("at"), x["start"].alias("upto"), F.lit(mask).alias("mask"))
        new = F.when(x["start"] >= so_far["at"], F.concat(so_far["pieces"], F.array(piece))).otherwise(so_far["pieces"])
        return F.struct(F.greatest(so_far["at"], x["end"]).alias("at"), new.alias("pieces"))

    # chunks of spans, each begun where the furthest of those before ends
    def walked(all_: Column) -> Column:
        chunk = lambda c: F.slice(all_, c * CHUNK + 1, CHUNK)
        chunks = F.sequence(F.lit(0), F.floor(F.size(all_) / CHUNK).cast("int"))
        begun = lambda ends, c: F.struct(F.coalesce(F.array_max(F.slice(ends, 1, c)), F.lit(0)).alias("at"), F.array().cast(f"array<{step}>").alias("pieces"))
        return _bound(F.transform(chunks, lambda c: F.array_max(F.transform(chunk(c), lambda x: x["end"]))), lambda ends: F.transform(chunks, lambda c: F.aggregate(chunk(c), begun(ends, c), add)))

    end = lambda w: F.array(F.struct(F.element_at(w, -1)["at"].alias("at"), F.length(text).alias("upto"), F.lit("").alias("mask")))
    pieces = _bound(_bound(spans, walked), lambda w: F.concat(F.flatten(F.transform(w, lambda x: x["pieces"])), end(w)))

    def block(i: Column, all_: Column) -> Column:
        lo, hi = i * BLOCK, (i + 1) * BLOCK
        own = F.filter(all_, lambda p: (p["at"] < hi) & (p["upto"] >= lo))
        cut = lambda b, p: F.concat(F.substring(b, F.greatest(p["at"] - lo, F.lit(0)) + 1, F.least(p["upto"], hi) - F.greatest(p["at"], lo)), F.when(p["upto"] < hi, p["mask"]).otherwise(F.lit("")))
        return _bound(F.substring(text, lo + 1, F.lit(BLOCK)), lambda b: F.array_join(F.transform(own, lambda p: cut(b, p)), ""))

    blocks = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int"))
    return _bound(pieces, lambda all_: F.array_join(F.transform(blocks, lambda i: block(i, all_)), ""))


def redact(docs: DataFrame, repository: Column, owner: Column, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans that look live masked; other documents are untouched."""
    # a document's own columns stay in a struct, so that no name can clash
    found = candidates(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), "text", repository.alias("repository"), owner.alias("owner"))).drop("text")
    # stored with the candidates, so that the patterns run once over each text
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = found.where("size(base) + size(extra) > 0").withColumn("text", F.col("doc.text"))
    verdict = judged(some, "repository", "owner").select("row", "live")

    changed = some.join(verdict, "row").withColumn("text", masked(F.col("text"), F.col("live"), mask))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    changed = changed.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
    return found.where("size(base) + size(extra) = 0").select("doc.*").union(changed)


def by_source() -> tuple[Column, Column]:
    """The documents table names no repositories: a source is an owner, each of its documents a repository."""
    return F.col("doc_id").cast("string"), F.col("source")


def op4_secret_scan(spark, sf_dir):
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), *by_source())


def _sql_spans(kind: int, sign: str, pattern: str, group: int, keep: str) -> str:
    sign = SIGNS[sign].replace("'", "''")
    p = pattern.replace("'", "''")
    return f"""
SELECT row, {kind} AS kind, s + k AS start, s + k + len(m) AS "end", v FROM (
  SELECT row, unnest(ms) AS m, unnest(vs) AS v, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: len(x))))) AS s,
    unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0))) AS k
  FROM (SELECT row, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, regexp_split_to_array(text, '{p}') AS ps
        FROM d WHERE regexp_matches(text, '{sign}'))) WHERE {keep}"""


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS repository FROM documents),
b AS ({_sql_spans(0, "assign", ASSIGN, 2, "len(v) >= 6")} UNION ALL {_sql_spans(1, "access", ACCESS, 0, "len(v) >= 20")} UNION ALL {_sql_spans(2, "hex", HEX, 0, "len(v) >= 24")}),
x AS ({_sql_spans(3, "mixed", MIXED, 0, "len(v) >= 24 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")}),
c AS (SELECT * FROM b UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.row = x.row AND b.start < x."end" AND x.start < b."end")),
o AS (SELECT v, count(DISTINCT owner) AS n, count(DISTINCT (owner, repository)) AS r FROM c JOIN d USING (row) GROUP BY v),
j AS (SELECT c.*, n, r, n <= {MAX_LIVE_OWNERS} AND r <= {MAX_LIVE_REPOSITORIES} AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || "end" AS name FROM c JOIN o USING (v)),
a AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base, coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live AND n = 1), '') AS spans,
  count(*) FILTER (WHERE kind < 3 AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND NOT live) AS n_example, max(n) AS most_owners, max(r) AS most_repositories FROM j GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example,
  coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repositories, 0)::BIGINT AS most_repositories
FROM d LEFT JOIN a USING (row)
"""
