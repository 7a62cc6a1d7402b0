"""Operator 3: personal data by weak supervision.

Fixed patterns find the base spans (email, ip, card, phone), which always stay. Wider patterns propose more candidates
(see WIDER). Labelers vote on every candidate, for (1), against (-1) or not at all (0): a strict form check, a
gazetteer, words before the span, words that speak against it, and the characters beside it. Expectation-maximisation
(Dawid and Skene's model of two classes, a class prior for each kind) estimates the labelers' reliabilities and each
candidate's probability without any labelled row; a logistic regression on votes and shape features is trained on those
probabilities, and decides which proposed spans are added.

Texts are read once: candidates and their features are written to the shared folder. Votes and features take few
values, so both fits need only the count of each combination (a table whose size doesn't depend on the input), taken
over all documents.

Null and empty texts have no spans. Repeated rows give repeated rows; null ids are allowed. Without candidates nothing
is added. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import map_texts, materialize, read

KINDS = ("email", "ip", "card", "phone", "ssn", "local_phone", "hidden_email", "iban", "person")
N_BASE = 4
VOTES = 5
ROUNDS = 50

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits are taken whole: a match that begins inside one could not succeed where the run failed
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DIGIT = re.compile("[0-9]{3}")
#: Candidates beyond the base patterns.
WIDER = (
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("local_phone", re.compile(r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")),
    ("hidden_email", re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,24}")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
    ("person", re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?(?!\w)")),
)
#: Fixed word lists of the labelers.
TLDS = frozenset(("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "us", "ca", "it", "nl", "ch", "at"))
IBAN_COUNTRIES = frozenset(("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"))
DIALLING = ("1", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "61", "81", "86", "91")
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "address"),
    "ip": ("ip", "address", "host", "server", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "hidden_email": ("email", "e-mail", "mail", "contact", "write"),
    "iban": ("iban", "account", "bank", "transfer"),
    "person": ("dear", "by", "from", "name", "contact", "patient"),
}
AGAINST = ("version", "isbn", "order", "invoice", "ref", "serial", "model", "build", "example", "page", "chapter")
_WORDS = re.compile(r"[a-z-]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each "@" with a domain back over the local part, so that no long word is scanned again and again."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def wider_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in WIDER:
        if kind == "hidden_email" and "at]" not in text and "at)" not in text or kind in ("ssn", "local_phone") and not _DIGIT.search(text):
            continue
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return out


def _strict(kind: str, s: str) -> int:
    digits = "".join(_DIGITS.findall(s))
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,24}", s) and ".." not in s else -1
    if kind == "ip":
        parts = s.split(".")
        return 1 if all(str(int(p)) == p for p in parts) and parts[0] not in ("0", "127", "255") else -1
    if kind == "card":
        return 1 if digits[0] in "3456" and len(digits) in (14, 15, 16, 19) else -1
    if kind == "phone":
        return 1 if s.count("(") == s.count(")") else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[-4:] == "0000" else 1
    if kind == "local_phone":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "iban":
        flat = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    return 0


def _gazetteer(kind: str, s: str) -> int:
    if kind in ("email", "hidden_email"):
        return 1 if re.split(r"[.\W]+", s.strip(".-"))[-1].lower() in TLDS else -1
    if kind == "phone":
        return 1 if s[1:].lstrip("(").startswith(DIALLING) else -1
    if kind == "iban":
        return 1 if s[:2] in IBAN_COUNTRIES else -1
    return 0


def votes_and_shape(text: str, a: int, kind: int, b: int) -> str:
    """Votes and shape features, each a character."""
    name, span = KINDS[kind], text[a:b]
    before = _WORDS.findall(text[max(0, a - 40) : a].lower())
    context = 1 if any(w in CONTEXT[name] for w in before[-4:]) else 0
    against = -1 if any(w in AGAINST for w in before[-3:]) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    alone = -1 if left.isalnum() or right.isalnum() else 1
    votes = (_strict(name, span), _gazetteer(name, span), context, against, alone)
    size = min((b - a) // 8, 4)
    return "".join("-0+"[v + 1] for v in votes) + str(size) + ("s" if left in ("", " ", "\n") else "o") + ("s" if right in ("", " ", "\n") else "p" if right in ".,;:!?" else "o")


def _hashed(spans) -> tuple[str, str]:
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return said, hashlib.sha256(said.encode()).hexdigest()


def find(text: str | None) -> tuple:
    """Counts of the base kinds, digest, base spans and proposed spans with features."""
    base = base_spans(text) if text else []
    more = wider_spans(text) if text else []
    counts = [sum(k == i for _, k, _ in base) for i in range(N_BASE)]
    described = [{"start": a, "kind": k, "end": b, "feat": votes_and_shape(text, a, k, b)} for a, k, b in base + more]
    return *counts, _hashed(base)[1], described


def candidates(df: DataFrame, id_col: str, text: str) -> DataFrame:
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found")

    def block(texts):
        return dict(zip(names, zip(*map(find, texts))))

    kind = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<start: bigint, kind: int, end: bigint, feat: string>>"
    return map_texts(df, text, block, kind, [id_col])


def reliabilities(kinds: np.ndarray, votes: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over combinations: each one's probability, and P(vote | class) by labeler, class and vote."""
    total = np.bincount(kinds, weight, len(KINDS))
    prob = 1 / (1 + np.exp(-votes.sum(axis=1, dtype=float)))  # a majority vote to begin with
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        for j in range(votes.shape[1]):
            for c, p in enumerate((1 - prob, prob)):
                n = np.bincount(votes[:, j] + 1, weight * p, 3) + 1.0  # one of each keeps shares from 0
                table[j, c] = n / n.sum()
        prior = (np.bincount(kinds, weight * prob, len(KINDS)) + 1) / (total + 2)
        logs = np.log(np.stack([1 - prior[kinds], prior[kinds]]))
        for j in range(votes.shape[1]):
            # an abstention depends on the kind, not on the class
            voted = votes[:, j] != 0
            logs[:, voted] += np.log(table[j][:, votes[voted, j] + 1])
        prob = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return prob, table


def _design(kinds: np.ndarray, feats: list[str]) -> np.ndarray:
    rows = []
    for k, f in zip(kinds.tolist(), feats):
        x = [1.0] + [float(k == i) for i in range(len(KINDS))]
        x += [float("-0+".index(c) - 1) for c in f[:VOTES]]
        x += [float(f[VOTES] == str(i)) for i in range(5)] + [float(f[VOTES + 1] == "s")] + [float(f[VOTES + 2] == c) for c in "sp"]
        rows.append(x)
    return np.array(rows)


def train_classifier(kinds: np.ndarray, feats: list[str], prob: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method with a small ridge."""
    x = _design(kinds, feats)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (prob - p)) - beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta += np.linalg.solve(bend, slope)
    return beta


def accepted(found: DataFrame) -> set[tuple[int, str]]:
    """Combinations of kind and features that the trained classifier takes for personal data."""
    counts = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.feat").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return set()
    counts.sort(key=lambda r: (r["kind"], r["feat"]))
    kinds, feats = np.array([r["kind"] for r in counts]), [r["feat"] for r in counts]
    weight = np.array([r["n"] for r in counts], float)
    votes = np.array([["-0+".index(c) - 1 for c in f[:VOTES]] for f in feats])
    prob, _ = reliabilities(kinds, votes, weight)
    beta = train_classifier(kinds, feats, prob, weight)
    return {(k, f) for k, f, z in zip(kinds.tolist(), feats, (_design(kinds, feats) @ beta).tolist()) if z >= 0}


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts of the base kinds, base_sha256, spans (base and accepted ones), one row per row."""
    found = materialize(candidates(df, id_col, text), "pii")
    good = [f"{k}{f}" for k, f in sorted(accepted(found)) if k >= N_BASE]
    take = lambda s: (s["kind"] < N_BASE) | F.array_contains(F.array(*map(F.lit, good)).cast("array<string>"), F.concat(s["kind"].cast("string"), s["feat"]))
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.filter("found", take))
    spans = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
