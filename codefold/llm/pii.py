"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates come from wide patterns. Three families of labelers vote +1, 0 or -1
on each: the strict pattern or checksum of its kind, gazetteers (top-level
domains, issuer prefixes, country codes, reserved networks, credential words)
and context (trigger words before the span, words of versions and orders, the
characters beside it). Votes are counted by pattern over the whole corpus,
which leaves a table bounded by the number of patterns; a two-class model with a
reliability for each labeler is fitted to it, and its posteriors train a
logistic classifier over votes, kind and shape. The strict matches of the four
base kinds always stay; the classifier adds other spans.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import id_text, ready, stored, work_dir

KINDS = ("email", "ip", "card", "phone", "account", "secret", "ssn", "iban", "ipv6", "key", "tel", "name", "address")
BASE = KINDS[:4]
LABELERS = ("strict", "gazetteer", "reserved", "trigger", "decoy", "edges", "variety")
#: Kinds judged by the classes of their characters, not by their digits.
WORDY = ("secret", "iban", "ipv6", "key", "name", "address")
#: A span is added from this probability on.
THRESHOLD = 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_BEGIN, _END = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_TEL = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\.? |[Nn]ame ?: ?)([A-Z][^\W\d_]{1,20}(?:[ -][A-Z][^\W\d_]{1,20}){0,2})")
_STREET = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq)(?![A-Za-z])")
_SIGN = re.compile(r"[=:]")
_NAMED = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}$")
_LEAD = re.compile(r"[ \t]{0,3}[\"']?")
_RUN = re.compile(r"[^\s\"']*+")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TRIGGER = {
    "email": re.compile(r"(?i)(?:e-?mail|contact|write to|mailto|@)\W{0,3}$"),
    "ip": re.compile(r"(?i)(?:\bip|host|address|server|addr)\W{0,3}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|payment)\W{0,3}$"),
    "phone": re.compile(r"(?i)(?:phone|tel|call|fax|mobile)\W{0,3}$"),
    "account": re.compile(r"(?i)(?:account|iban|acct|card|number)\W{0,3}$"),
    "secret": re.compile(r"(?i)(?:password|passwd|pwd|secret|token|key|bearer)[\s\"'=:]{0,5}$"),
    "ssn": re.compile(r"(?i)(?:ssn|social|security|number)\W{0,3}$"),
    "iban": re.compile(r"(?i)(?:iban|account|acct|bank|konto)\W{0,3}$"),
    "ipv6": re.compile(r"(?i)(?:\bip|ipv6|host|address|server|addr)\W{0,3}$"),
    "key": re.compile(r"(?i)(?:key|pem)\W{0,3}$"),
    "tel": re.compile(r"(?i)(?:phone|tel|call|fax|mobile|at)\W{0,3}$"),
    "name": re.compile(r"(?i)(?:name|dear|from|signed|by)\W{0,3}$"),
    "address": re.compile(r"(?i)(?:address|lives? at|at|to)\W{0,3}$"),
}
_DECOY = re.compile(r"(?i)(?:\bversion|\bv|release|isbn|order|invoice|build|sha\d*|md5)\W{0,3}$")
#: Fixed word lists of the gazetteers.
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk us eu ch at nl be ca au jp cn in br".split())
COUNTRY = ("1", "33", "34", "44", "49", "39", "41", "43", "31", "32", "46", "47", "45", "48", "55", "61", "81", "86", "91")
ISSUER = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65", "35", "30", "36", "38")
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
GIVEN = frozenset("anna anne carlos david elena emma hans jean john jose karl laura luis maria marie mary michael paul peter robert sarah thomas".split())
TOKEN = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "sk-", "xoxb-", "xoxp-", "AIza")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(int(d) for d in digits[::-2])) % 10 == 0


def emails(text: str):
    """Leftmost matches: an address's local part is the run of its characters before an ``@``."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        low = found.end() if found else at + 1
        if found:
            yield start, low
        at = text.find("@", low)


def mod97(account: str) -> bool:
    """The check of an international account number without spaces."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def further(text: str):
    """``(kind, start, end, strict)`` of the kinds that have no base form: each is found leftmost, without overlap within its kind."""
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), True
    for m in _IBAN.finditer(text):
        size, end, seen = IBAN_LENGTH.get(m[0][:2], 34), m.start(), 0
        while end < m.end() and seen < size:
            seen += text[end] != " "
            end += 1
        if 15 <= seen <= 34 and (m[0][:2] not in IBAN_LENGTH or seen == size):
            yield "iban", m.start(), end, mod97(text[m.start() : end].replace(" ", ""))
    for m in _IPV6.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if m[0] != "::":
            yield "ipv6", *m.span(), True
    at = 0
    while (begin := _BEGIN.search(text, at)) and (end := _END.search(text, begin.end())):
        at = end.end()
        yield "key", begin.start(), at, True
    for m in _TEL.finditer(text):
        yield "tel", *m.span(), True
    for m in _PERSON.finditer(text):
        yield "name", *m.span(1), True
    for m in _STREET.finditer(text):
        yield "address", *m.span(), True


def _gaps(spans: list[tuple[str, int, int, bool]]):
    """A function that says whether a span meets none of these."""
    taken = sorted((a, b) for _, a, b, _ in spans)
    starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    return lambda a, b: not ((k := int(np.searchsorted(starts, b))) and ends[k - 1] > a)


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, strict)`` by kind and start; strict ones of a base kind are that kind's matches."""
    out = [("email", s, e, True) for s, e in emails(text)]
    for m in _IP.finditer(text):
        out.append(("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            good = luhn(digits)
            out.append(("card" if good else "account", *m.span(), good))
    for m in _PHONE.finditer(text):
        out.append(("phone", *m.span(), 9 <= len(_DIGITS.sub("", m[0])) <= 15))
    more = list(further(text))
    accounts = [(a, b) for kind, a, b, strict in more if kind == "iban" and strict]
    if accounts:  # digits of an account number are no candidate of their own
        out = [c for c in out if c[0] != "account" or not any(a <= c[1] and c[2] <= b for a, b in accounts)]
    free = _gaps(out)
    out += [c for c in more if free(c[1], c[2])]
    free = _gaps(out)
    named, stop = set(), 0
    for sign in _SIGN.finditer(text):
        if _NAMED.search(text[max(0, sign.start() - 24) : sign.start()]):
            start = _LEAD.match(text, sign.end()).end()
            if start >= stop:  # signs inside one run share its end, so a run is read once
                stop = _RUN.match(text, start).end()
            if stop - start >= 8:
                named.add((start, stop))
    last = 0
    for s, e in sorted(named | {m.span() for m in _OPAQUE.finditer(text) if _DIGIT.search(m[0])}):
        if s >= last and free(s, e):
            out.append(("secret", s, e, (s, e) in named or text.startswith(TOKEN, s)))
            last = e
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(out, key=lambda c: (order[c[0]], c[1]))


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """The labelers' votes on one span, in the order of ``LABELERS``."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = _DIGITS.sub("", span) if kind not in WORDY else ""
    gazetteer = reserved = 0
    if kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in DOMAINS else -1
    elif kind == "ip":
        reserved = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind in ("card", "account"):
        gazetteer = 1 if digits.startswith(ISSUER) else -1
    elif kind == "phone":
        gazetteer = 1 if digits.startswith(COUNTRY) else -1
    elif kind == "iban":
        gazetteer = 1 if span[:2] in IBAN_LENGTH else -1
    elif kind == "ipv6":
        reserved = -1 if span.lower().startswith(("fe80:", "::1", "2001:db8:", "ff")) else 0
    elif kind == "tel":
        gazetteer = 1 if digits[0] in "23456789" else -1
    elif kind == "name":
        gazetteer = 1 if span.split()[0].lower() in GIVEN else 0
    elif kind in ("key", "address"):
        gazetteer = 1
    elif kind == "secret":
        gazetteer = 1 if span.startswith(TOKEN) else 0
    open_left = not text[start - 1 : start].isalnum()
    open_right = not text[end : end + 1].isalnum()
    kinds = len(set(digits)) if kind not in WORDY else sum(any(f(c) for c in span[:4096]) for f in (str.isdigit, str.isupper, str.islower))
    enough = 3 if kind not in WORDY else 2
    return (
        1 if strict else -1,
        gazetteer,
        reserved,
        1 if _TRIGGER[kind].search(before) else 0,
        -1 if _DECOY.search(before) else 0,
        1 if open_left and open_right else -1,
        1 if kinds >= enough or kind == "email" else -1,
    )


def pattern_of(kind: str, vote: tuple[int, ...], size: int) -> str:
    """What the models see of a span: kind, votes and a length class of four."""
    return f"{kind}|{''.join('-0+'[v + 1] for v in vote)}|{min(3, size // 12)}"


def fit(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, float]]:
    """Each pattern's probability from the classifier, and each labeler's estimated accuracy.

    ``patterns``: counts over the corpus. The table has at most kinds x 3^labelers
    x 4 rows, whatever the corpus. An empty table gives empty results.
    """
    if not patterns:
        return {}, {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    parts = [p.split("|") for p in names]
    kind = np.array([KINDS.index(p[0]) for p in parts])
    v = np.array([["-0+".index(c) - 1 for c in p[1]] for p in parts])
    q = 1 / (1 + np.exp(-v.sum(axis=1)))
    right = np.full((len(LABELERS), 2), 0.7)
    for _ in range(rounds):
        prior = np.array([(n[kind == k] @ q[kind == k] + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        for j in range(len(LABELERS)):
            yes, no = v[:, j] > 0, v[:, j] < 0
            # how often a vote agrees with either class, smoothed towards 0.7
            right[j, 1] = (n[yes] @ q[yes] + 7) / (n[yes | no] @ q[yes | no] + 10)
            right[j, 0] = (n[no] @ (1 - q[no]) + 7) / (n[yes | no] @ (1 - q[yes | no]) + 10)
        right = right.clip(0.05, 0.99)
        log = np.log(prior[kind] / (1 - prior[kind]))
        log += np.where(v > 0, np.log(right[:, 1] / (1 - right[:, 0])), np.where(v < 0, np.log((1 - right[:, 1]) / right[:, 0]), 0)).sum(axis=1)
        q = 1 / (1 + np.exp(-log.clip(-30, 30)))
    shape = np.array([int(p[2]) for p in parts])
    x = np.hstack([np.eye(len(KINDS))[kind], v, np.eye(4)[shape]]).astype(float)
    weight, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        w -= 1.0 * (x.T @ (weight * (p - q)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
    return dict(zip(names, p.tolist())), dict(zip(LABELERS, right.mean(axis=1).tolist()))


_FOUND = "doc_id long, kind array<string>, start array<int>, stop array<int>, strict array<boolean>, pattern array<string>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` its candidate spans with their vote patterns."""
    ready(docs.sparkSession)

    def find(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text in batch.column(1).to_pylist():
                found = candidates(text)
                out[0].append([c[0] for c in found])
                out[1].append([c[1] for c in found])
                out[2].append([c[2] for c in found])
                out[3].append([c[3] for c in found])
                out[4].append([pattern_of(k, votes(text, k, s, e, strict), e - s) for k, s, e, strict in found])
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.list_(t)) for o, t in zip(out, kinds))], ["doc_id", "kind", "start", "stop", "strict", "pattern"])

    return id_text(docs).mapInArrow(find, _FOUND)


def detect_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans``.

    ``docs``: ``doc_id, text``; other columns are not read. Null text counts as
    empty, with no spans; a null or repeated ``doc_id`` keeps its row; an empty
    table gives an empty result. Texts are searched whole, in time linear in
    their length. ``spans`` lists ``kind:start:end`` (code points, end exclusive)
    by kind as in ``KINDS``, then start; ``base_sha256`` is over the strict
    matches of the four base kinds in that form. ``n_spans`` counts all spans,
    so a document with any of them has ``n_spans > 0``.
    """
    found = stored(find_candidates(docs), work_dir(docs.sparkSession, "spans"))
    counted = found.select(F.explode("pattern").alias("pattern")).groupBy("pattern").count().collect()
    probability, _ = fit({r.pattern: r["count"] for r in counted})
    added = {p for p, x in probability.items() if x >= threshold}

    def decide(batches):
        for batch in batches:
            rows = []
            for kinds, starts, stops, stricts, patterns in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                base, spans, n = [], [], dict.fromkeys(BASE, 0)
                for kind, s, e, strict, pattern in zip(kinds, starts, stops, stricts, patterns):
                    if strict and kind in BASE:
                        base.append(f"{kind}:{s}:{e}")
                        spans.append(base[-1])
                        n[kind] += 1
                    elif pattern in added:
                        spans.append(f"{kind}:{s}:{e}")
                rows.append((*n.values(), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans), len(spans) - len(base), len(spans)))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
