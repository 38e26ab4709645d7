"""Vector code compression: product codes with integer codebooks, by partial-distance search.

Each part of a vector is given to the nearest of its codebook's entries. Dimensions are
taken in descending variance of the codebook. After the first of them the nearest entry so
far is measured whole; entries whose partial distance exceeds that best complete distance
drop out (strictly: a tie may have a lower index), the others are compacted into a list,
which alone meets the further dimensions and loses entries with each.

Codebooks hold 256 entries at most, so they are sent to all tasks. A round sums parts by
entry within tasks first; only those sums are shuffled, whatever the hottest entry holds.

Cases as in ``vectors``, but a row without vec_id is coded too: only the codebooks' start
takes none. Equal vec_ids start in order of their components. Vectors are filled with
zeros to the longest, and that to a multiple of the number of parts. Fewer than 256 rows
give as many entries; an empty table gives no rows. Null labels count as one label. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, on_workers, record, stored
from .vectors import exact_kind, gathered, integer_vectors, matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Share of the dimensions that all entries meet, and rows worked on at once.
DENSE = 3 / 4
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` for each row of ``x`` and its squared distance; ties to the lower index."""
    n, width = x.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    length = lambda v: float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    kind = exact_kind(2 * (length(x) + length(book)) ** 2)
    x, book = x.astype(kind), book.astype(kind)
    first = max(1, int(width * DENSE))
    a, b = x[:, :first], book[:, :first]
    partial = (a * a).sum(axis=1)[:, None] + ((b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))
    guess = partial.argmin(axis=1)
    whole = partial[np.arange(n), guess] + ((x[:, first:] - book[guess, first:]) ** 2).sum(axis=1)
    vi, ei = np.nonzero(partial <= whole[:, None])
    s = partial[vi, ei]
    across, along = np.ascontiguousarray(x.T), np.ascontiguousarray(book.T)
    for d in range(first, width):
        s = s + (across[d][vi] - along[d][ei]) ** 2
        keep = s <= whole[vi]
        vi, ei, s = vi[keep], ei[keep], s[keep]
    # of each row the first in (distance, index) order; each has its guess at least
    order = np.lexsort((ei, s, vi))
    vi, ei, s = vi[order], ei[order], s[order]
    begins = np.flatnonzero(np.concatenate([[True], vi[1:] != vi[:-1]])) if n else np.zeros(0, np.int64)
    return ei[begins], s[begins].astype(np.int64)


def _parts(lists: pa.ListArray, width: int) -> Iterator[np.ndarray]:
    """Matrices of the same rows for each part."""
    v = matrix(lists, width)
    return iter(np.split(v, PARTS, axis=1))


def _round(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of its parts' mean."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        sums, counts = [b * 0 for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                for part, x in enumerate(_parts(batch.slice(i, ROWS).column("v"), width)):
                    at, _ = nearest(x, books[part])
                    np.add.at(sums[part], at, x)
                    counts[part] += np.bincount(at, minlength=len(counts[part]))
        for part, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield record(part=pa.array(np.full(len(used), part), pa.int32()), entry=pa.array(used, pa.int32()), n=pa.array(n[used]), sums=pa.array(list(sums[part][used]), pa.list_(pa.int64())))

    found = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [b.copy() for b in books]
    for part, entry, place, n, x in total.collect():  # one row for each component of the codebooks at most
        out[part][entry, place] = int(x) // n
    return out


def coded(df: DataFrame, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """Stored ``(vec_id, label, code, error)`` of all rows of ``df (vec_id, embedding, label)``, and the codebooks of each part."""
    rows = stored(integer_vectors(df, scale, F.col("vec_id").cast("long").alias("vec_id"), F.col("label")), "integers")
    on_workers(rows.sparkSession)
    width = (rows.agg(F.max(F.size("v"))).first()[0] or 0) + PARTS - 1
    width -= width % PARTS
    start = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(ENTRIES).select("v").collect()
    books = [b.copy() for b in np.split(np.array([[*r.v, *[0] * (width - len(r.v))] for r in start], np.int64).reshape(len(start), width), PARTS, axis=1)]
    if not start:  # no row has a vec_id: there is nothing to start from but zeros
        books = [np.zeros((1, width // PARTS), np.int64)] * PARTS
    for _ in range(ROUNDS):
        books = _round(rows, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                codes, errors = zip(*(nearest(x, book) for x, book in zip(_parts(batch.column("v"), width), books, strict=True)), strict=True)
                text = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
                yield record(vec_id=batch.column("vec_id"), label=batch.column("label"), code=pa.array([text[2 * PARTS * j : 2 * PARTS * (j + 1)] for j in range(batch.num_rows)], pa.string()), error=pa.array(sum(errors)))

    kind = dict(rows.dtypes)["label"]
    return stored(rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "coded"), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(df: DataFrame, scale: int = 1024) -> DataFrame:
    """Codes and errors of all vectors, with their label's error and the codebooks' digest."""
    rows, books = coded(df, scale)
    # a label may hold a third of all rows: sums are made within tasks first, and stored, so that a join's large partition can be split
    by_label = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_code_compression(spark, sf_dir):
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after the other; each assigns the parts to their nearest entries."""
    steps = [
        "with v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as c from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"parts as materialized (select vec_id, label, p as part, c[p * len(c) // {PARTS} + 1 : (p + 1) * len(c) // {PARTS}] as x from v, range({PARTS}) as r(p))",
        f"ranked as (select *, row_number() over (partition by part order by vec_id, x) - 1 as entry from parts where vec_id is not null)",
        f"book0 as materialized (select part, entry, x from ranked where entry < {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"near{i} as materialized (select vec_id, label, part, x, d, entry from (select a.vec_id, a.label, a.part, a.x, b.entry, list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x) as d, "
            f"row_number() over (partition by a.part, a.vec_id, a.x order by d, b.entry) as place from parts a join book{i} b on a.part = b.part) where place = 1)"
        )
        if i < ROUNDS:
            steps.append(f"mean{i} as (select part, entry, list(m order by place) as x from (select part, entry, place, floor(sum(y) / count(*)) as m from (select part, entry, unnest(x) as y, unnest(range(len(x))) as place from near{i}) group by all) group by all)")
            steps.append(f"book{i + 1} as materialized (select b.part, b.entry, coalesce(m.x, b.x) as x from book{i} b left join mean{i} m on m.part = b.part and m.entry = b.entry)")
    steps.append(f"codes as (select vec_id, label, string_agg(printf('%02x', entry::integer), '' order by part) as code, sum(d)::bigint as error from near{ROUNDS} group by all)")
    steps.append(f"hashed as (select sha256(string_agg(y::bigint::varchar, ',' order by part, entry, place)) as h from (select part, entry, unnest(x) as y, unnest(range(len(x))) as place from book{ROUNDS}))")
    return ",\n".join(steps) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from codes, hashed"


OP13_SQL = _sql()
