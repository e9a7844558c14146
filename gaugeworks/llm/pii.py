"""Operator 7: personal data, secrets, and terms that give them away.

Base spans are e-mail addresses, IPv4 addresses, payment card and phone numbers; keys (long runs
of letters and digits mixed as in tokens and passwords) are spans of kind "key". Protected
entities are each distinct value and each kind as a whole (a name that stands by one address
discloses that one, a word that only announces keys discloses that there is one). Terms (runs of letters and digits, so names and numbers alike) within
`REACH` terms of an entity in its line are its context; over the whole corpus, with n(c) terms in
contexts of entity c, n(t) occurrences of term t, n(c,t) of them in contexts of c, and N in all,

    IC(c) = -ln n(c)/N,    PMI(c;t) = ln (n(c,t)/n(t)) / (n(c)/N),

a term discloses an entity if PMI(c;t) >= DISCLOSURE * IC(c), it stands near it in at least
`SUPPORT` different lines, and it makes up `SHARE` of the terms in its contexts (so an entity has
at most 1 / SHARE candidates, however large the corpus). Its occurrences in the entity's contexts are sanitised: a term whose
first `STEM` characters, taken as a class of terms, stay under the threshold is generalised to
them (kind "stem"), else it is removed (kind "term").

All occurrences count, those of copies too: a table repeated k times has k times every count, and
the same spans. Nulls: a null text is empty. Rows with the same doc_id and text have the same spans.
Spans may overlap (a number can be a card and a phone); texts are redacted over their union. Very
long texts and lines are whole. Ties of the threshold disclose. No rows give no rows. Extra columns
are not read, and `redacted` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .arrow_text import ascii_words, strings_of, text_slices, texts_of, utf8_views

KINDS = ("email", "ip", "card", "phone", "key", "term", "stem")
KEY, TERM_KIND, STEM_KIND = 4, 5, 6
REACH = 12
SUPPORT = 3
DISCLOSURE = 0.9
SHARE = 0.001
#: Characters that a generalised term keeps.
STEM = 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")
#: Runs that may be keys: see `key_spans`.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Letters in a row that no key has: such runs are words joined by marks.
PROSE = re.compile(r"[a-z]{12}|[A-Z]{16}|[a-zA-Z]{20}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds, by start and kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def key_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of 20 or more key characters, at least 4 letters, 4 digits and 8 different ones, that are no prose and no base span."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        digits = sum(c in "0123456789" for c in run)
        if digits >= 4 and sum(c.isalpha() for c in run) >= 4 and len(set(run)) >= 8 and not PROSE.search(run) and not any(a < m.end() and m.start() < b for a, _, b in taken):
            out.append((m.start(), KEY, m.end()))
    return out


def own_spans(text: str) -> list[tuple[int, int, int]]:
    """Base and key spans, by start and kind."""
    base = base_spans(text)
    keys = key_spans(text, base)
    return sorted(base + keys) if keys else base


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


KIND_HASHES = [hash_of(kind) for kind in KINDS]


def stem_of(term: str) -> str:
    """The class of a lower-cased term: its first characters; a term no longer than them is its own."""
    return term if len(term) <= STEM else f"{term[:STEM]}*"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms near each entity in its line, but those inside a span; each once for an entity."""
    terms = [m.span() for m in TERM.finditer(text)]
    starts, ends = [a for a, _ in terms], [b for _, b in terms]
    breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
    lines: dict[int, int] = {}
    covered = bytearray(len(text))
    for a, _, b in spans:
        covered[a:b] = b"\1" * (b - a)
    out, seen = [], set()
    for start, kind, end in spans:
        value = text[start:end].lower() if kind == 0 else digits_of(text[start:end]) if kind in (2, 3) else text[start:end]
        entity = hash_of(f"{KINDS[kind]}:{value}")
        n = bisect_right(breaks, start) - 1
        low, high = breaks[n] + 1, breaks[bisect_left(breaks, end)]
        if n not in lines:
            lines[n] = hash_of(text[low:high])
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        for k in [*range(max(before - REACH, 0), before), *range(after, min(after + REACH, len(terms)))]:
            a, b = terms[k]
            if a < low or b > high or 1 in covered[a:b]:
                continue
            term = text[a:b].lower()
            for protected in (entity, KIND_HASHES[kind]):
                if (protected, a) not in seen:
                    seen.add((protected, a))
                    out.append({"entity": protected, "line": lines[n], "term": hash_of(term), "stem": hash_of(stem_of(term)), "start": a, "end": b})
    return out


CONTEXT = pa.list_(pa.struct([("entity", pa.int64()), ("line", pa.int64()), ("term", pa.int64()), ("stem", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
SPANS_TYPE = "array<struct<start:int,kind:int,end:int>>"
SCANNED = f"key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, own {SPANS_TYPE}, near array<struct<entity:long,line:long,term:long,stem:long,start:int,end:int>>"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        counts, digests, spans, near = np.zeros((part.num_rows, 4), np.int64), [], [], []
        for k, text in enumerate(strings_of(texts_of(part))):
            found = own_spans(text)
            base = [x for x in found if x[1] < KEY]
            for _, kind, _ in base:
                counts[k, kind] += 1
            digests.append(hashlib.sha256(",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in base).encode()).hexdigest())
            spans.append([{"start": a, "kind": kind, "end": b} for a, kind, b in found])
            near.append(contexts(text, found) if found else [])
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, SPANS), pa.array(near, CONTEXT)],
            ["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "own", "near"],
        )


#: Stands for all terms together.
ALL_TERMS = hash_of("*")


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of a slice's lower-cased terms, their stems and all together; a row each."""
    for part in text_slices(batches):
        words, _ = ascii_words(texts_of(part))
        counted = words.value_counts()
        tally: dict[str, int] = {}
        for word, n in zip(strings_of(counted.field(0)), counted.field(1).to_numpy().tolist()):
            low = word.lower()
            for term in (low,) if low.isalnum() else TERM.findall(low):
                tally[term] = tally.get(term, 0) + n
        stems: dict[str, int] = {}
        for term, n in tally.items():
            if len(term) > STEM:
                stem = term[:STEM]
                stems[stem] = stems.get(stem, 0) + n
        names = [*map(hash_of, tally), *(hash_of(f"{x}*") for x in stems), ALL_TERMS]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([*tally.values(), *stems.values(), sum(tally.values())], pa.int64())], ["term", "n"])


def row_key() -> Column:
    """Names a text among those of its doc_id."""
    return F.xxhash64(F.col("text").cast("string")).alias("key")


def joined_by_entity(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """An inner join; the few rows known of the kinds (at most 1 / SHARE terms each) are broadcast, as kinds are hot keys."""
    kind = F.col("entity").isin(KIND_HASHES)
    values = rows.where(~kind).join(known.where(~kind), on)
    return values.unionByName(rows.where(kind).join(F.broadcast(known.where(kind)), on))


def disclosing(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, general) over the disclosure threshold; general: its stem is not, so that it may stay."""
    near = scanned.select(F.explode("near").alias("o")).select("o.*")
    entities = near.groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = near.groupBy("entity", "term", "stem").agg(F.count("*").alias("n_ct"), F.count_distinct("line").alias("support")).where(F.col("support") >= SUPPORT)
    stems = near.groupBy("entity", "stem").agg(F.count("*").alias("n_cs"))
    pairs = joined_by_entity(pairs, entities, ["entity"]).where(F.col("n_ct") >= SHARE * F.col("n_c"))
    pairs, _ = written(pairs.join(stems, ["entity", "stem"]), "pairs")
    counted = docs.select(F.col("text").cast("string")).mapInArrow(count_terms, "term long, n long")
    wanted = pairs.select(F.explode(F.array("term", "stem", F.lit(ALL_TERMS))).alias("term")).distinct()
    counts, _ = written(counted.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    total = counts.where(F.col("term") == ALL_TERMS).agg(F.max("n").alias("total"))
    ic = -F.log(F.least(F.col("n_c") / F.col("total"), F.lit(0.999999)))

    def discloses(near_n: str, n: str) -> Column:
        return F.log(F.least(F.col(near_n) / F.col(n), F.lit(1.0))) + ic >= DISCLOSURE * ic

    known = pairs.join(counts.select("term", F.col("n").alias("n_t")), "term").join(counts.select(F.col("term").alias("stem"), F.col("n").alias("n_s")), "stem").crossJoin(F.broadcast(total))  # one row
    return known.where(discloses("n_ct", "n_t")).select("entity", "term", (~discloses("n_cs", "n_s")).alias("general"))


def term_spans(scanned: DataFrame, flagged: DataFrame) -> DataFrame:
    """(key, doc, terms): spans of disclosing terms, for the rows that have any; a term that must go is not generalised."""
    near = scanned.select("key", F.col("doc_id").alias("doc"), F.explode("near").alias("o")).select("key", "doc", "o.*")
    flagged, _ = written(flagged, "flagged")
    hit = joined_by_entity(near, flagged, ["entity", "term"]).groupBy("key", "doc", "start", "end").agg(F.bool_and("general").alias("general"))
    span = F.struct("start", F.when(F.col("general"), STEM_KIND).otherwise(TERM_KIND).alias("kind"), "end")
    return hit.groupBy("key", "doc").agg(F.collect_list(span).alias("terms"))  # as many as a row has terms near entities


def found_spans(docs: DataFrame) -> DataFrame:
    """key, doc_id, counts, base_sha256 and spans array<struct<start,kind,end>> of every row."""
    rows = docs.select(row_key(), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned, _ = written(rows.mapInArrow(scan, SCANNED), "scanned")
    terms, _ = written(term_spans(scanned, disclosing(scanned, docs)), "terms")
    same = (scanned["key"] == F.col("term_key")) & scanned["doc_id"].eqNullSafe(F.col("doc"))
    joined = scanned.drop("near").join(terms.withColumnRenamed("key", "term_key"), same, "left")
    return joined.withColumn("spans", F.array_sort(F.concat("own", F.coalesce("terms", F.array().cast(SPANS_TYPE))))).drop("terms", "own", "term_key", "doc")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as text, n_key, n_term, sensitive) of every row.

    n_term counts disclosing terms, generalised or removed; sensitive rows have any span.
    """
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(test) -> Column:
        return F.size(F.filter("spans", lambda s: test(s["kind"]))).cast("long")

    more = [number(lambda k: k == KEY).alias("n_key"), number(lambda k: k > KEY).alias("n_term"), (F.size("spans") > 0).alias("sensitive")]
    return found_spans(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), *more)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the union of its spans replaced by the kind that begins first, a stem by its first characters."""
    out, done = [], 0
    open_start, open_end, kind = -1, -1, 0
    for a, k, b in [*sorted(spans), (len(text) + 1, 0, len(text) + 1)]:
        if a < open_end:
            open_end, kind = max(open_end, b), TERM_KIND if kind == STEM_KIND else kind
            continue
        if open_end >= 0:
            out += [text[done:open_start], f"{text[open_start : open_start + STEM]}*" if kind == STEM_KIND else f"[{KINDS[kind].upper()}]"]
            done = open_end
        open_start, open_end, kind = a, b, k
    return "".join(out) + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with its texts redacted, n_chars (of any type) as of the new text where there is that column."""
    own = "_".join(["found_spans", *docs.columns])  # no name of docs
    spans = found_spans(docs).where(F.exists("spans", lambda s: s["kind"] > KEY)).select(F.col("key").alias(f"{own}_key"), F.col("doc_id").alias(f"{own}_doc"), F.col("spans").alias(own)).dropDuplicates([f"{own}_key", f"{own}_doc"])
    spans, _ = written(spans, "term-spans")  # few texts have any; Spark broadcasts them if they are small
    same = (F.xxhash64(docs["text"].cast("string")) == F.col(f"{own}_key")) & docs["doc_id"].cast("long").eqNullSafe(F.col(f"{own}_doc"))
    joined = docs.join(spans, same, "left").drop(f"{own}_key", f"{own}_doc")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            new = []
            for text, spans in zip(part.column("text").to_pylist(), part.column(own).to_pylist()):
                found = [(s["start"], s["kind"], s["end"]) for s in spans] if spans else own_spans(text) if text else []
                new.append(redact_text(text, found) if found else text)
            columns = dict(zip(part.schema.names, part.columns))
            columns["text"] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in columns:
                kind = part.schema.field("n_chars").type
                columns["n_chars"] = pa.array([len(t) if t is not None else None for t in new], pa.int64()).cast(kind)
            columns.pop(own)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(rewrite, docs.schema)
