"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base: leftmost non-overlapping matches of each kind, found in time linear in the text; matches that fail their check
are dropped. The model reads islands: stretches of neighbouring words that hold digits or an @, in tokens (runs of
letters, runs of digits, single other characters). Entities are bounded, at `LONGEST` tokens, and so are islands: one
begins at most `BACK` characters before its first digit or @, takes at most `PART` characters of a word, takes no
further word once it has `REACH` characters, and ends after `ISLAND` tokens; what lies beyond begins the next island, so
that all digits and @ of a text are in one. A segment of an island is an entity of some kind with a score by features of
the whole span; tokens outside entities score 0. As no entity goes without a digit or @, islands decode on their own.
Boundaries and kinds are chosen jointly by dynamic programming. Features see tokens by shape alone (and which segments
pass the check of card numbers), so that islands of one shape share a decoding. Weights are learned by maximum
likelihood from the base matches in a bounded sample of documents (`sample`, about), on the `shapes` most frequent
shapes of islands in it, with `hidden` of the telling first characters withheld so that spans are known by their other
features too. Model spans that touch a base span are dropped.

Null and empty texts have no spans; repeated rows and clashing columns don't matter (doc_id and text alone are read).
"""

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import text_chunks

KINDS = ("email", "ip", "card", "phone")
LONGEST, ISLAND, FEATURES = 16, 48, 21
BACK, PART, REACH = 40, 64, 160
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SIGN = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
_WORD = re.compile(rf"\S{{1,{PART}}}")
_NEXT = re.compile(rf"\s{{1,2}}(?=\S{{0,{PART}}}[0-9@])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches that pass, in order."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            free = m.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def islands(text: str):
    """(start of each token, ends with the end of the last; shape of each token) of each island."""
    done = 0
    while m := _SIGN.search(text, done):
        low = max(done, m.start() - BACK)
        start = next((k + 1 for k in range(m.start() - 1, low - 1, -1) if text[k].isspace()), low)
        end = m.end()
        if w := _WORD.match(text, end):
            end = w.end()
        while end - start < REACH and (w := _NEXT.match(text, end)):
            end = _WORD.match(text, w.end()).end()
        tokens = list(_TOKEN.finditer(text, start, end))[:ISLAND]
        end = max(tokens[-1].end(), m.end())
        shapes = tuple(shape(t[0]) for t in tokens)
        if sum(int(x.rstrip("!")) for x in shapes if x[0].isdigit()) >= 14:
            shapes += (passing([t[0] for t in tokens]),)
        yield [t.start() for t in tokens] + [tokens[-1].end()], shapes
        done = end


def shape(token: str) -> str:
    """Letters by `a`; digits by their number, and `!` if of three they exceed 255; all white space alike."""
    if "0" <= token[0] <= "9":
        return f"{min(len(token), 20)}" + "!" * (len(token) == 3 and token > "255")
    return "a" if token[0].isalpha() else " " if token[0].isspace() else token


def passing(tokens: list[str]) -> str:
    """Segments of 14 to 19 digits, blanks and hyphens that pass the check of card numbers, as one more mark of the island."""
    out = []
    for i in range(len(tokens)):
        digits = ""
        for j in range(i, min(len(tokens), i + LONGEST)):
            if "0" <= tokens[j][0] <= "9":
                digits += tokens[j]
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(f"{i}-{j + 1}")
            elif tokens[j] not in " -" or j == i:
                break
    return "luhn:" + "/".join(out)


def length(shapes: tuple[str, ...]) -> int:
    return len(shapes) - bool(shapes and shapes[-1].startswith("luhn:"))


def segments(shapes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Candidate segments (start, end) of an island by token, and the features of each as a whole."""
    spans, rows, marked = [], [], set()
    if shapes and shapes[-1].startswith("luhn:"):
        shapes, marked = shapes[:-1], set(shapes[-1][5:].split("/"))
    for i, first in enumerate(shapes):
        if not (first == "a" or first[0].isdigit() or first in "+("):
            continue
        ats = dots = after = digits = runs = small = letters = spaces = pairs = others = 0
        for j in range(i, min(len(shapes), i + LONGEST)):
            t = shapes[j]
            if t[0].isdigit():
                n = int(t.rstrip("!"))
                digits, runs, small = digits + n, runs + 1, small + (n <= 3 and t[-1] != "!")
            elif t == "a":
                letters += 1
            elif t == "@":
                ats += 1
            elif t == ".":
                dots, after = dots + 1, after + (ats > 0)
            elif t == " ":
                spaces += 1
            elif t in "()":
                pairs += 1
            elif t not in "-_%+":
                others += 1
            if not (t == "a" or t[0].isdigit()) or not (ats or digits):
                continue
            left = i == 0 or shapes[i - 1] in (" ", '"', "'", "(", "<", ":", ",", "|")
            right = j + 1 == len(shapes) or shapes[j + 1] not in ("@", "-", "_", "+", "a") and not shapes[j + 1][0].isdigit()
            spans.append((i, j + 1))
            rows.append(
                (
                    1, ats == 1, ats > 1, after > 0, first == "+", dots == 3 and runs == 4 == small and not letters, 10 <= digits <= 13,
                    14 <= digits <= 15, 16 <= digits <= 19, 14 <= digits <= 19 and f"{i}-{j + 1}" in marked, digits < 7, digits > 19, letters > 0,
                    spaces > 0, pairs == 2, others > 0, 3 <= runs <= 5 and not letters, left, right, letters > 0 and not ats, digits > 6 and not dots and not letters
                )
            )
    return np.array(spans, np.int64).reshape(-1, 2), np.array(rows, float).reshape(-1, FEATURES)


class SemiMarkov:
    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), FEATURES)) if weights is None else weights
        self.known: dict = {}

    def decode(self, shapes: tuple[str, ...]) -> list[tuple[int, int, int]]:
        """Entities (start, kind, end) by token, of the best joint choice."""
        if shapes not in self.known:
            if len(self.known) > 200_000:
                self.known = {}
            spans, rows = segments(shapes)
            scores = rows @ self.weights.T
            size = length(shapes)
            best, came = [0.0] * (size + 1), [None] * (size + 1)
            by_end: dict[int, list] = {}
            for (i, j), s in zip(spans.tolist(), scores, strict=True):
                by_end.setdefault(j, []).append((i, int(s.argmax()), float(s.max())))
            for j in range(1, size + 1):
                best[j] = best[j - 1]
                for i, kind, s in by_end.get(j, ()):
                    if best[i] + s > best[j]:
                        best[j], came[j] = best[i] + s, (i, kind)
            out, j = [], size
            while j:
                if came[j]:
                    out.append((came[j][0], came[j][1], j))
                    j = came[j][0]
                else:
                    j -= 1
            self.known[shapes] = out[::-1]
        return self.known[shapes]

    def fit(self, examples: list[tuple[tuple[str, ...], tuple, int]], steps: int = 80, ridge: float = 0.02) -> "SemiMarkov":
        """examples: shapes, entities (start, kind, end) by token, and how often. Gradient ascent (Adam) on the log likelihood."""
        data, n_all = [], sum(n for _, _, n in examples)
        for shapes, gold, n in examples:
            spans, rows = segments(shapes)
            where = {tuple(s): k for k, s in enumerate(spans.tolist())}
            picked = np.zeros((len(spans), len(KINDS)))
            for i, kind, j in gold:
                if (i, j) in where:
                    picked[where[i, j], kind] = 1
            if len(spans):
                data.append((length(shapes), spans, rows, picked, n / n_all))
        m = v = np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            grad = -ridge * self.weights
            for size, spans, rows, picked, share in data:
                scores = rows @ self.weights.T
                whole = np.logaddexp.reduce(scores, axis=1)
                ends = [np.flatnonzero(spans[:, 1] == j) for j in range(size + 1)]
                starts = [np.flatnonzero(spans[:, 0] == i) for i in range(size + 1)]
                alpha, beta = np.zeros(size + 1), np.zeros(size + 1)
                for j in range(1, size + 1):
                    k = ends[j]
                    alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[spans[k, 0]] + whole[k])])
                for i in range(size - 1, -1, -1):
                    k = starts[i]
                    beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[spans[k, 1]] + whole[k])])
                chance = np.exp(alpha[spans[:, 0], None] + scores + beta[spans[:, 1], None] - alpha[size])
                grad = grad + share * ((picked - chance).T @ rows)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            self.weights = self.weights + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def learn(docs: DataFrame, sample: int = 2000, shapes: int = 150, hidden: float = 0.2) -> np.ndarray:
    """Weights from about `sample` documents of docs(doc_id, text), on the `shapes` most frequent island shapes with their labels."""
    n = docs.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 20)) / float(1 << 20)
    some = docs.select("text").where((chance < min(1.0, sample / max(n, 1))) & F.col("text").rlike("[0-9@]"))

    def run(batches):
        for _, texts in text_chunks(batches):
            found: Counter = Counter()
            for text in texts:
                base = {(s, e): k for s, k, e in base_spans(text)}
                for starts, shapes in islands(text):
                    at = {s: k for k, s in enumerate(starts)}
                    gold = [(at[s], k, at[e]) for (s, e), k in base.items() if s in at and e in at]
                    found[" ".join(x if x != " " else "_" for x in shapes), ";".join(f"{a},{k},{b}" for a, k, b in sorted(gold))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())],
                names=["shapes", "gold", "n"]
            )

    rows = some.mapInArrow(run, "shapes string, gold string, n long").groupBy("shapes", "gold").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.desc("n"), "shapes", "gold").limit(shapes).collect()
    examples = []
    for r in rows:
        parts = tuple(" " if x == "_" else x for x in r.shapes.split(" "))
        gold = tuple(tuple(map(int, g.split(","))) for g in r.gold.split(";") if g)
        examples.append((parts, gold, r.n))
        plus = [g for g in gold if parts[g[0]] == "+" and length(parts) == len(parts)]
        if plus:  # the same without the sign that tells all by itself
            cut = plus[0][0]
            moved = tuple((a - (a > cut), k, b - (b > cut)) for a, k, b in gold)
            examples.append((parts[:cut] + parts[cut + 1 :], moved, max(1, int(hidden * r.n))))
    return SemiMarkov().fit(examples).weights if examples else np.zeros((len(KINDS), FEATURES))


def all_spans(text: str, model: SemiMarkov) -> tuple[list, list]:
    """Base spans, and all spans, as (start, kind, end)."""
    base = base_spans(text)
    begins, reach, added = [s for s, _, _ in base], [*accumulate((e for _, _, e in base), max)], []
    for starts, shapes in islands(text):
        for i, kind, j in model.decode(shapes):
            s, e = starts[i], starts[j]
            before = bisect_left(begins, e)  # of base spans that begin ahead of its end, none may reach beyond its start
            if not before or reach[before - 1] <= s:
                added.append((s, kind, e))
    return base, sorted(base + added)


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _mapped(docs: DataFrame, train: DataFrame, sample: int, rows_of, schema: str) -> DataFrame:
    weights = learn(train.select("doc_id", "text"), sample)

    def run(batches):
        model = SemiMarkov(weights)
        for batch, texts in text_chunks(batches):
            yield rows_of(batch, [(t, *(all_spans(t, model) if _SIGN.search(t) else ([], []))) for t in texts])

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, sample: int = 2000) -> DataFrame:
    """Of every row of docs(doc_id, text): counts of base spans, base_sha256 and spans (kind:start:end, comma-joined)."""

    def rows_of(batch, found):
        counts = [[sum(k == kind for _, k, _ in base) for _, base, _ in found] for kind in range(len(KINDS))]
        digests = [hashlib.sha256(named(base).encode()).hexdigest() for _, base, _ in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                pa.array([named(s) for _, _, s in found], pa.string())
            ],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _mapped(rows, rows, sample, rows_of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, sample: int = 2000) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; other columns as they are."""

    def rows_of(batch, found):
        texts = []
        for text, _, spans in found:
            out, end = [], 0
            for s, k, e in spans:
                if e > end:
                    out += [text[end : max(s, end)], f"[{KINDS[k].upper()}]"]
                    end = e
            texts.append("".join(out) + text[end:])
        at = batch.schema.get_field_index("text")
        texts = pa.array(
            [t if ok else None for t, ok in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], batch.schema.field(at).type
        )
        return batch.set_column(at, "text", texts)

    return _mapped(docs, docs, sample, rows_of, docs.schema)
