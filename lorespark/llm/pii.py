"""Personal data by weak supervision.

Four kinds have exact base rules. Candidates of six further kinds, which only context tells from other text, are voted on by
labelers: patterns, gazetteers, the context before, and the shape. Expectation-maximisation over the votes of all candidates
estimates for each kind how far each labeler can be trusted, and the posteriors train a span classifier on the candidates' own
features, which decides. Whatever it accepts is added to the base spans.

Kinds: ``secret`` (credentials: long runs without a space, and whatever follows a word that names secrets), ``tel`` (grouped
digits without a plus), ``mail`` (addresses spelled out), ``date`` (days, of birth where the text says so), ``name`` (capitalised
words after a title or a given name) and ``address`` (a house number beside a street). Every step takes time in proportion to
the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import broadcast_if_small, dense, documents, unused

# Fixed values of the contract. Dotted numbers are found as whole runs, which no part of the pattern can match in two ways.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
DIGITS = re.compile(r"[0-9]")

ADDED = ("secret", "tel", "mail", "date", "name", "address")
#: Gazetteers, small and general.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "credential", "passphrase", "passwort", "kennwort", "contraseña", "mot de passe")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")
GIVEN = frozenset("Anna Anne Antonio Carlos Carmen Claire David Elena Emma Eva Frank George Hans Isabel James Jane Jean John José Juan Julia Karl Laura Lisa Louis Lucas Maria Marie Mary Michael Miguel Paul Peter Pierre Robert Sarah Sophie Thomas William".split())
TLDS = frozenset("com org net edu gov info de fr es uk eu io".split())
#: Words before a candidate that speak for its kind, and words that speak against any.
CUES = {
    "secret": SECRET_WORDS,
    "tel": ("phone", "tel", "call", "mobile", "fax", "anruf", "appel", "llam", "móvil", "handy", "contact"),
    "mail": ("mail", "contact", "write", "reach", "kontakt", "contacto", "écri"),
    "date": ("born", "birth", "dob", "geboren", "geburt", "né le", "née le", "naissance", "nacid", "nacimiento"),
    "name": ("name", "heiß", "appelle", "llamo", "dear", "liebe", "cher", "querid", "signed", "regards", "contact"),
    "address": ("live", "address", "wohn", "adresse", "habite", "vivo", "direcci", "at ", "ship", "located"),
}
AGAINST = ("http", "www", "isbn", "page", "version", "figure", "table", "chapter", "seite", "página", "vol.", "order", "price", "$", "€")

RUN = re.compile(r"[A-Za-z0-9_=+/:-]{12,}")
#: The value after a word that names secrets and a sign or verb that gives it.
GIVEN_SECRET = re.compile(r"(?i)\b(?:" + "|".join(SECRET_WORDS) + r")\b[ ]{0,2}(?:[:=]|is\b|ist\b|est\b|es\b)[ ]{0,2}[\"']?([^\s\"']{4,})")
KEY_SHAPES = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{16,}")
GROUPED = re.compile(r"\(?[0-9][0-9() ./-]*[0-9]")
PHONE_SHAPE = re.compile(r"\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}")
SPELLED = re.compile(r"(?<= )[\[({<]?(?:at|arobase|arroba)[\])}>]? [A-Za-z0-9-]{1,63}(?: [\[({<]?(?:dot|punkt|point|punto)[\])}>]? [A-Za-z0-9-]{1,63})+")
DAY = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[12][0-9]{3}|[12][0-9]{3}-[0-9]{2}-[0-9]{2})(?![0-9/-])")
CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? ({CAPITAL}(?: {CAPITAL}){{0,2}})")
NAMED = re.compile(rf"\b(?:{'|'.join(sorted(GIVEN))}) {CAPITAL}(?: {CAPITAL})?")
STREETS = re.compile(
    rf"\b[0-9]{{1,5}}[a-z]? {CAPITAL}(?: {CAPITAL})? (?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd)\b"
    rf"|\b{CAPITAL}(?:straße|strasse|weg|platz|gasse) [0-9]{{1,4}}\b"
    r"|\b[0-9]{1,4},? (?:rue|avenue|boulevard|place) [^\s,.;]{2,40}(?: [^\s,.;]{2,40}){0,2}"
    rf"|\b(?:[Cc]alle|[Aa]venida|[Pp]laza) {CAPITAL},? [0-9]{{1,4}}\b"
)
#: Votes: 1 personal, 0 not, -1 no opinion.
LABELERS = ("pattern", "gazetteer", "before", "shape", "wordlike")
FEATURES = ("bias", *ADDED, "length", "digits", "upper", "entropy", "gazetteer", "cue", "against", "pattern", "shape")
#: The final classifier learns from at most about so many candidates, by hash.
TRAINING_SPANS = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the run of local characters before an @, from the end of the match before at the earliest."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", domain.end() if domain else at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time of every run of them, with parts up to 255."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        ends = list(accumulate(len(p) + 1 for p in parts))
        for i in range(0, len(parts) - 3, 4):
            own = [p.lstrip("0") for p in parts[i : i + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in own):
                yield m.start() + (ends[i - 1] if i else 0), m.start() + ends[i + 3] - 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m.group())) <= 15]
    return out


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all that may be personal, in order; of what overlaps the first."""
    found = [(*m.span(), "secret") for m in RUN.finditer(text) if "=" in m.group() or DIGITS.search(m.group())]
    found += [(*m.span(1), "secret") for m in GIVEN_SECRET.finditer(text)]
    found += [(*m.span(), "address") for m in STREETS.finditer(text)]
    found += [(*m.span(), "date") for m in DAY.finditer(text)]
    for m in GROUPED.finditer(text):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 15 and not m.group().isdigit():
            found.append((*m.span(), "tel"))
    for m in SPELLED.finditer(text):
        start = m.start() - 1
        while start > 0 and m.start() - start <= 64 and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() - 1:
            found.append((start, m.end(), "mail"))
    found += [(*m.span(1), "name") for m in TITLED.finditer(text)]
    found += [(*m.span(), "name") for m in NAMED.finditer(text)]
    order = {k: i for i, k in enumerate(("secret", "address", "date", "tel", "mail", "name"))}
    out, done = [], 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], order[x[2]], -x[1])):
        if start >= done:
            out.append((start, end, kind))
            done = end
    return out


def judged(text: str, start: int, end: int, kind: str) -> tuple[int, int, int, int, int]:
    """The labelers' votes on a candidate."""
    run = text[start:end]
    low, before = run.lower(), text[max(0, start - 40) : start].lower()
    value = run.rpartition("=")[2] or run
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    cue, against = any(w in before for w in CUES[kind]), any(w in before for w in AGAINST)
    if kind == "secret":
        vowels = sum(c in "aeiouAEIOU" for c in value) / max(1, letters)
        pattern = 1 if KEY_SHAPES.search(run) or (letters and re.fullmatch(r"[0-9a-f]{12,}", value)) else -1
        listed = 1 if any(w in low for w in SECRET_WORDS) else -1
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
        shape = 1 if turns >= 5 and len(value) >= 12 else -1 if cue else 0
        word = 0 if len(value) >= 12 and (digits == 0 or letters == 0 or (vowels > 0.3 and digits <= 2)) else -1
        return pattern, listed, 1 if cue else 0 if against else -1, shape, word
    if kind == "tel":
        pattern = 1 if PHONE_SHAPE.fullmatch(run) else 0
        shape = 1 if 9 <= digits <= 12 else 0
        listed, word = -1, 0 if len(set(value) & set("0123456789")) <= 2 else -1
    elif kind == "mail":
        pattern, shape = 1, -1
        listed, word = 1 if low.rsplit(" ", 1)[-1] in TLDS else 0, -1
    elif kind == "date":
        day = [int(x) for x in re.split("[./-]", run)]
        valid = max(day) < 2100 and sorted(day)[0] >= 1 and sorted(day)[0] <= 12 and sorted(day)[1] <= 31
        pattern, shape, listed, word = 1 if valid else 0, 1 if 1900 <= max(day) <= 2015 else 0, -1, -1 if cue else 0
    elif kind == "name":
        titled = any(before.rstrip(" .").endswith(t.lower()) for t in TITLES)
        pattern, shape = 1 if titled else -1, 1 if " " in run else -1
        listed, word = 1 if run.split(" ")[0] in GIVEN else -1, -1 if titled or cue else 0
    else:
        pattern, shape, listed, word = 1, 1 if digits else 0, -1, -1
    return pattern, listed, 1 if cue else 0 if against else -1, shape, word


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, list[int], list[float]]]:
    """(start, end, kind, votes, features) of what may be personal outside base spans."""
    spans = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    for start, end, kind in places(text):
        i = bisect_left(starts, end)  # spans that begin before the end
        if i and reach[i - 1] > start:
            continue
        votes, run = list(judged(text, start, end, kind)), text[start:end]
        features = [1.0, *[float(kind == k) for k in ADDED], min(len(run), 40) / 40, sum(c.isdigit() for c in run) / len(run), sum(c.isupper() for c in run) / len(run)]
        features += [entropy(run) / 6, float(votes[1]), float(votes[2] == 1), float(votes[2] == 0), float(votes[0]), float(votes[3])]
        yield start, end, kind, votes, features


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, hit rates, false-alarm rates) of the labelers by expectation-maximisation over vote patterns and their counts.

    Each labeler has a chance to vote 1, given that it votes, for secrets and for others; both are smoothed, and the first is
    kept above the second, which tells the two classes apart.
    """
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    said = votes >= 0
    belief = np.clip(0.5 + 0.25 * np.where(said, 2 * votes - 1, 0).sum(axis=1), 0.05, 0.95)
    prior, hit, alarm = 0.5, np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.2)
    for _ in range(rounds):
        w1, w0 = n * belief, n * (1 - belief)
        prior = float(np.clip(w1.sum() / n.sum(), 0.01, 0.99))
        hit = ((votes == 1) * w1[:, None]).sum(axis=0) + 4
        hit /= (said * w1[:, None]).sum(axis=0) + 5
        alarm = ((votes == 1) * w0[:, None]).sum(axis=0) + 1
        alarm /= (said * w0[:, None]).sum(axis=0) + 5
        hit = np.maximum(hit, alarm + 0.01)
        belief = posterior(votes, prior, hit, alarm)
    return prior, hit, alarm


def posterior(votes: np.ndarray, prior: float, hit: np.ndarray, alarm: np.ndarray) -> np.ndarray:
    hit, alarm = np.clip(hit, 0.01, 0.99), np.clip(alarm, 0.01, 0.99)
    odds = np.where(votes == 1, np.log(hit / alarm), np.where(votes == 0, np.log((1 - hit) / (1 - alarm)), 0.0)).sum(axis=1)
    return 1 / (1 + np.exp(-(odds + math.log(prior / (1 - prior)))))


def fit(x: np.ndarray, belief: np.ndarray, steps: int = 40, l2: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (belief - p) - l2 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spots): base spans, and candidates with votes and features, of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spots = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                spots.append([{"start": a, "end": b, "kind": k, "votes": v, "features": f} for a, b, k, v, f in candidates(text, own)])
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            spot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(base, span), pa.array(spots, spot)], names=["doc_id", "key", "base", "spots"])

    schema = "doc_id long, key long, base array<struct<kind:string,start:int,end:int>>, spots array<struct<start:int,end:int,kind:string,votes:array<int>,features:array<double>>>"
    return documents(docs).mapInArrow(each, schema)


def train(rows: DataFrame, most: int = TRAINING_SPANS) -> np.ndarray | None:
    """Weights of the span classifier; None without candidates.

    The reliabilities of a kind's labelers come from the vote patterns of all its candidates, the fit takes a hash sample.
    """
    spots = rows.select("doc_id", F.inline("spots"))
    counted = spots.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most kinds * 3 ** labelers
    if not counted:
        return None
    found = {k: reliabilities(sorted((tuple(r["votes"]), r["n"]) for r in counted if r["kind"] == k)) for k in {r["kind"] for r in counted}}
    share = min(1.0, most / sum(r["n"] for r in counted))
    sample = spots.where(F.pmod(F.xxhash64("doc_id", "start", "features"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = sorted((list(r["features"]), list(r["votes"]), r["kind"]) for r in sample.select("features", "votes", "kind").collect())
    if not sample:
        return None
    belief = np.concatenate([posterior(np.array([v]), *found[k]) for _, v, k in sample])
    return fit(np.array([f for f, _, _ in sample]), belief)


def detect(docs: DataFrame, most: int = TRAINING_SPANS) -> DataFrame:
    """(doc_id, key, base, spans array<struct<kind, start, end>>) of each document: base spans, and all spans with the added ones.

    Positions count characters, end exclusive. Spans come by kind (email, ip, card, phone, then secret, tel, mail, date, name,
    address), then start. Null and empty texts have none.
    """
    rows = dense(found(docs))
    weights = train(rows, most)
    if weights is None:
        return rows.select("doc_id", "key", "base", F.col("base").alias("spans"))

    def score(f):
        parts = [F.get(f, i) * float(w) for i, w in enumerate(weights)]
        return sum(parts[1:], parts[0])

    def of_kind(kind: str) -> Column:
        own = F.filter(F.col("accepted"), lambda s: s["kind"] == kind)
        return F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    accepted, added = F.filter("spots", lambda s: score(s["features"]) > 0), [of_kind(k) for k in ADDED]
    return rows.select("doc_id", "key", "base", accepted.alias("accepted")).select("doc_id", "key", "base", F.concat("base", *added).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans.

    Null and empty texts have no spans. Repeated rows have a row each, with equal results.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    rows = detect(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return rows.select("doc_id", *[count(k) for k in KINDS], added, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of a text replaced by its kind, and n_chars, where there is one, counted anew. All rows and columns stay.

    Null texts stay null, empty ones empty; repeated rows are masked alike.
    """
    rows = detect(docs).where(F.size("spans") > 0).select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    doc, key, spans = unused(docs, "doc", "key", "spans")
    small = broadcast_if_small(dense(rows)).withColumnsRenamed({"doc_id": doc, "key": key, "spans": spans})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(small, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")

    @F.pandas_udf("string")
    def hide(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([mask(t, [(s["kind"], s["start"], s["end"]) for s in own]) for t, own in zip(texts, spans)], dtype=object)

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    out = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(hide("text", F.coalesce(spans, none))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with <KIND> in place of each span; spans that overlap one before are merged into it."""
    if not text or not spans:
        return text
    out, done, last = [], 0, -1
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= last:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = last = max(last, end)
    return "".join([*out, text[done:]])
