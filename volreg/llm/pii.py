"""Personal data by weak supervision.

Base spans (e-mail, IP, card, phone) are found by fixed patterns. Further candidates are
numbers in groups and capitalised names after an address word. Labelers of three sorts
vote on each candidate, base or further: forms (regex), word lists beside it (gazetteer)
and what surrounds it (context); each says yes, no or nothing. Candidates are counted by
their votes and their form over the whole corpus, a table of fixed size. Expectation-
maximisation estimates each labeler's reliability and the candidates' probabilities from
that table; a logistic classifier on the form alone is then trained on the probabilities,
and adds the further candidates that it accepts.

Cases. A null or empty text has no spans. Rows with equal doc_id are judged each for
itself. A null doc_id is handed on. Tables without rows give none; without candidates
nothing is added. Spans that start at one place are ordered by kind. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, record, stored, with_text

# The patterns of the contract. An e-mail is sought from its @ and an IP in
# runs of digits and dots, as a search from each place of a long run would take its square.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_PART = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone", "number", "name"]

# Further candidates, and words of the labelers.
NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,4}(?![\w.-])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? ([A-Z][a-z]+ [A-Z][a-z]+)\b")
CUES = {"tel", "phone", "telephone", "mobile", "cell", "fax", "call", "contact", "ssn", "iban", "account", "passport", "email", "mail", "address", "card", "visa", "name", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "telefon", "téléphone", "teléfono"}
TECHNICAL = {"version", "isbn", "issn", "order", "page", "pages", "section", "sha", "md5", "figure", "table", "chapter", "no", "vol", "rfc", "build", "release", "license"}

_LETTERS = re.compile(r"[^\W\d_]+")
_FORMS = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
#: Labelers in the order of their votes.
LABELERS = ["form", "gazetteer", "technical", "context"]
#: A candidate is added from this probability of its form on; even odds are not enough.
MIN_PROBABILITY = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``local@domain``: a local part is what stands before the @, back to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            local = at
            for size in (64, at - done):  # most are short
                other = [m.end() for m in _NOT_LOCAL.finditer(text, max(done, at - size), at)]
                if other or at - size <= done:
                    local = other[-1] if other else done
                    break
            if local < at:
                yield local, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)
        while 0 <= at < done:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of four numbers with single dots, of numbers up to 255."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        four: list[re.Match] = []
        for part in _PART.finditer(text, run.start(), run.end()):
            if four and part.start() != four[-1].end() + 1:
                four = []
            four.append(part)
            if len(four) == 4:
                if all(len(x[0].lstrip("0")) <= 3 and int(x[0].lstrip("0") or 0) <= 255 for x in four):
                    yield four[0].start(), part.end()
                four = []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the contract's spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)] + [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span."""
    found = [(m.start(), 4, m.end()) for m in NUMBER.finditer(text) if 7 <= sum(map(str.isdigit, m[0])) <= 15]
    found += [(m.start(1), 5, m.end(1)) for m in NAME.finditer(text)]
    starts, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    # of the base spans that begin before a candidate's end, the last end tells whether one reaches into it
    return sorted(x for x in found if not (n := bisect_left(starts, x[2])) or ends[n - 1] <= x[0])


#: Code points from a candidate to another that count as beside it.
BESIDE = 60


def all_beside(spans: list[tuple[int, int, int]]) -> list[bool]:
    """Whether another span begins near a span's end or ends near its start, for each."""
    starts, ends = sorted(x[0] for x in spans), sorted(x[2] for x in spans)
    within = lambda values, at: bisect_right(values, at + BESIDE) - bisect_left(values, at - BESIDE)
    return [within(starts, b) + within(ends, a) > 2 * (b - a <= BESIDE) for a, _, b in spans]


def judge(text: str, span: tuple[int, int, int], beside: bool) -> tuple[int, int]:
    """Votes (base 3, a digit for each labeler: 0 nothing, 1 no, 2 yes) and form (bits) of a candidate."""
    start, kind, end = span
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    near = [w.lower() for w in _LETTERS.findall(before)[-3:]]
    form = 2 if kind in (0, 2) or kind == 4 and _FORMS.fullmatch(own) else 0 if kind == 5 else 1 if kind == 4 else 2
    gazetteer = 2 if CUES.intersection(near) else 0
    technical = 1 if TECHNICAL.intersection(near) else 0
    glued = bool(before[-1:].strip() and before[-1:] not in "(\"'<:=,;") or bool(after[:1].isalnum())
    context = 2 if beside else 1 if glued else 0
    votes = form + 3 * gazetteer + 9 * technical + 27 * context
    digits = sum(map(str.isdigit, own))
    bits = [kind == k for k in range(6)] + [digits >= 10, "(" in own, "-" in own, "." in own, bool(gazetteer), bool(before[-1:] in ":=")]
    return votes, sum(1 << i for i, b in enumerate(bits) if b)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: list[list[int]] = [[], [], [], []]
    digest, base_out, more = [], [], []
    for text in batch.column("text").to_pylist():
        base = base_spans(text)
        further = further_spans(text, base)
        both = base + further
        for k in range(4):
            counts[k].append(sum(x[1] == k for x in base))
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        digest.append(hashlib.sha256(joined.encode()).hexdigest())
        base_out.append([dict(start=a, kind=k, end=b) for a, k, b in base])
        more.append([dict(start=s[0], kind=s[1], end=s[2], votes=v, form=f) for s, near in zip(both, all_beside(both), strict=True) for v, f in [judge(text, s, near)]])
    span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
    return record(
        doc_id=batch.column("doc_id"), **{f"n_{n}": pa.array(counts[k], pa.int64()) for k, n in enumerate(KINDS[:4])}, base_sha256=pa.array(digest, pa.string()),
        base=pa.array(base_out, pa.list_(pa.struct(span))), candidates=pa.array(more, pa.list_(pa.struct([*span, ("votes", pa.int32()), ("form", pa.int32())]))))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation: each pattern's probability, and the labelers' tables P(vote | truth, it votes).

    ``votes`` has a row for each pattern of votes and a column for each labeler, ``n`` how
    often each occurs. A labeler is as reliable in its yes as in its no, never less than
    chance, so that truth and its opposite cannot change places; one that says nothing
    tells nothing, and a candidate without votes has even odds.
    """
    yes, no = votes == 2, votes == 1
    sure = np.full(votes.shape[1], 0.8)
    for _ in range(rounds):
        odds = (yes * 1.0 - no) @ np.log(sure / (1 - sure))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        right = ((yes * p[:, None] + no * (1 - p)[:, None]) * n[:, None]).sum(0)
        sure = np.clip((right + 8) / (((yes | no) * n[:, None]).sum(0) + 10), 0.55, 0.99)
    return p, np.stack([np.stack([sure, 1 - sure], 1), np.stack([1 - sure, sure], 1)], 1)


def classifier(features: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method with a small penalty."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) - 0.1 * w
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
    return w


FORM_BITS = 12


def accepted_forms(counts: list[tuple[int, int, int]]) -> dict[int, float]:
    """The classifier's probability of each form, trained on ``(votes, form, n)`` counts."""
    if not counts:
        return {}
    votes = np.array([[v // 3**j % 3 for j in range(len(LABELERS))] for v, _, _ in counts])
    n = np.array([c for _, _, c in counts], float)
    p, _ = reliabilities(votes, n)
    bits = np.array([[f >> i & 1 for i in range(FORM_BITS)] for _, f, _ in counts], float)
    w = classifier(bits, p, n)
    q = 1 / (1 + np.exp(-np.clip(np.hstack([np.ones((len(bits), 1)), bits]) @ w, -30, 30)))
    return {f: float(x) for (_, f, _), x in zip(counts, q, strict=True)}


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by kind, digest of the base spans, all spans, added ones."""
    key = docs.schema["doc_id"].dataType.simpleString()
    span = "start: long, kind: int, end: long"
    schema = f"doc_id {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<{span}>>, candidates array<struct<{span}, votes: int, form: int>>"
    found = stored(map_batches(with_text(docs, "doc_id"), _scan, schema), "pii")
    # at most 3 ** 4 patterns of votes for each of 2 ** 12 forms, whatever the corpus
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.form").count().orderBy("votes", "form").collect()
    accepted = [f for f, p in accepted_forms([tuple(r) for r in counts]).items() if p >= MIN_PROBABILITY]
    names = F.array(*map(F.lit, KINDS))
    added = F.filter("candidates", lambda c: (c["kind"] >= 4) & (c["form"].isin(accepted) if accepted else F.lit(False)))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size(added).cast("long").alias("n_added"))


def op10_pii(spark, sf_dir):
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
