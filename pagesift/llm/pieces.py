"""Encoding to and decoding from the pieces of a public SentencePiece model, with n-best segmentations.

The lattice of a text has a node before each character and an edge for each piece. Forward Viterbi gives the best
score from the start to each node; a backward A* search from the end uses it as its heuristic, which is exact, so
complete paths leave the queue best first. No piece holds a space after another character, nor a line end, so the
lattice falls apart into words (and, where no piece of the model mixes letters with others, at each such change); n-best
lists of words are kept in a bounded cache of the worker and added up. The Viterbi passes run over arrays of all new
words of one length; they tell how much the second best loses, and so which few words of a text need the A* search. The
search holds a score for each character and as many states as paths are wanted, so that a word of any length fits.

Piece scores are -log(2 + rank) by the model's own order of pieces; characters outside it fall back to bytes, each far
below any piece. Decoding gives back exactly the text. Null and empty texts have no pieces and score 0; ties of score
go to the path whose last differing piece is the shorter one. Only doc_id and text are read.
"""

import hashlib
import heapq
import math
import re
from array import array
from collections import defaultdict
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import text_chunks
from pagesift.llm.lattice import PieceTable

#: Words held by a worker's cache at most, and their letters; beyond, it starts anew.
CACHE, LETTERS = 200_000, 1 << 24
SPACE = "▁"
#: Marks within words that no text holds: for a real ▁, and for a line end.
_PRIVATE, _LINE = "\udfff", "\udffe"
_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")


def load(path: str) -> dict:
    """From a model file: the id and score of each piece, and the ids of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    first = max(bytes_) + 1
    pieces = {model.id_to_piece(i): (i, -math.log(2 + i - first)) for i in range(first, model.get_piece_size())}
    return {"pieces": pieces, "bytes": bytes_, "longest": max(map(len, pieces)), "byte_score": -math.log(2 + len(pieces)) - 10.0}


class Lattice:
    def __init__(self, model: dict, n_best: int):
        self.bytes, self.byte_score = model["bytes"], model["byte_score"]
        self.n, self.seen, self.trie, self.held = n_best, {}, {}, 0
        self.ids, self.others, self.sums = [], [], np.zeros((3, 0))
        # letters are apart from all else in every piece, but for such signs as ² in pieces that mix them with others
        odd = {c for p in model["pieces"] if len(re.findall(r"[^\W\d_]+|[\W\d_]+", p.lstrip(SPACE))) > 1 for c in p if not c.isalpha()}
        letters = rf"[^\W\d_{re.escape(''.join(sorted(odd)))}]+"
        assert all(len(re.findall(f"{letters}|.", q, re.S)) == 1 for p in model["pieces"] if re.search(letters, q := p.lstrip(SPACE)))
        self.pattern = re.compile(rf"{SPACE}*{letters}|\n|{SPACE}*(?:(?!{letters})[^{SPACE}\n])+|{SPACE}+")

        self.table = PieceTable(list(model["pieces"]))
        self.piece_ids, self.scores = (np.array([*(x[k] for x in model["pieces"].values()), none]) for k, none in ((0, -1), (1, -np.inf)))
        self.texts = {i: p.replace(SPACE, " ") for p, (i, _) in model["pieces"].items()}
        for piece, (i, score) in model["pieces"].items():
            level = self.trie  # of pieces from their last character on
            for c in piece[:0:-1]:
                level = level.setdefault(c, [{}, None, 0.0])[0]
            level.setdefault(piece[0], [{}, None, 0.0])[1:] = [(i,), score]

    def _into(self, word: str, end: int, best: array) -> list[tuple[float, int, tuple[int, ...], float]]:
        """The edges into a node, best first: score of the best path that ends with it, where it starts, its ids and score."""
        level, out, start = self.trie, [], end
        while start and (found := level.get(word[start - 1])):
            start -= 1
            level, ids, score = found
            if ids:
                out.append((best[start] + score, start, ids, score))
        if not out or out[0][1] != end - 1:  # the character is no piece
            raw = (SPACE if word[end - 1] == _PRIVATE else word[end - 1]).encode(errors="surrogatepass")
            score = self.byte_score * len(raw)
            out.append((best[end - 1] + score, end - 1, tuple(self.bytes[b] for b in raw), score))
        return sorted(out, reverse=True)

    def search(self, word: str) -> list[tuple[float, array]]:
        """The n best segmentations of a word, best first: score and ids. Memory grows with the word's length alone."""
        size, best = len(word), array("d", [0.0])
        for end in range(1, size + 1):
            best.append(self._into(word, end, best)[0][0])
        # A state stands for the paths that end with the edges behind a node (a chain, shared by states) and go on with its
        # k-th best edge or a later one. Its heuristic is exact: the best of them is followed to the start at once, and each
        # node on the way leaves the next edge as a state of its own. As each state ends in a path of just its score, no
        # more states are kept than paths are wanted.
        queue, out, pushed = [(-best[size], 0, size, 0, 0.0, None)], [], 0
        while queue and len(out) < self.n:
            _, _, node, k, behind, chain = queue.pop(0)
            while node:
                edges = self._into(word, node, best)
                if k + 1 < len(edges) and self.n > 1:
                    pushed += 1
                    queue.append((-(edges[k + 1][0] + behind), pushed, node, k + 1, behind, chain))
                    if len(queue) > 64 + self.n:
                        queue = heapq.nsmallest(self.n, queue)
                _, node, ids, score = edges[k]
                k, behind, chain = 0, behind + score, (ids, chain)
            found = array("i")
            while chain:
                found.extend(chain[0])
                chain = chain[1]
            out.append((behind, found))
            queue = heapq.nsmallest(self.n - len(out), queue)
        return out

    def chunks(self, text: str) -> list[str]:
        """The text's words without the first of the spaces that each begins with; those after a line end begin with _LINE."""
        if not text:
            return []
        text = text.replace(SPACE, _PRIVATE).replace(" ", SPACE)
        if text.startswith(SPACE) or SPACE + SPACE in text:
            return [w[1:] for w in _SPACED.findall(SPACE + text)]
        return text.replace("\n", SPACE + _LINE).split(SPACE)

    def _many(self, words: list[str], size: int):
        """Forward and backward Viterbi over words of one length: ids of the best segmentation, its score, and the first loss.

        Words with a character that is no piece give None.
        """
        edges = self.table.edges(words, size)
        scores = [(n, self.scores[e]) for n, e in edges]  # index -1 is the last: no piece
        plain = (edges[0][1] >= 0).all(0)
        best, back = np.full((2, size + 1, len(words)), -np.inf)
        step = np.zeros((size + 1, len(words)), np.int8)
        best[0] = back[size] = 0
        for end in range(1, size + 1):
            for n, s in scores:
                if n <= end:
                    s = best[end - n] + s[end - n]
                    np.copyto(step[end], n, where=s > best[end])
                    np.maximum(best[end], s, out=best[end])
        for start in range(size - 1, -1, -1):
            for n, s in scores:
                if n <= size - start:
                    np.maximum(back[start], s[start] + back[start + n], out=back[start])
        rows, node, path = np.arange(len(words)), np.where(plain, size, 0), []
        index, used = np.full((size + 1, size, len(words)), -1, np.int32), np.zeros((size, len(words)), np.int8)
        for n, e in edges:
            index[n, : len(e)] = e
        while node.any():
            n = step[node, rows]
            live, node = node > 0, np.maximum(node - n, 0)
            path.append(np.where(live, self.piece_ids[index[n, node, rows]], -1))
            used[node[live], rows[live]] = n[live]
        second = np.full(len(words), -np.inf)
        for n, s in scores:
            through = best[: len(s)] + s + back[n:]
            through[used[: len(s)] == n] = -np.inf
            np.maximum(second, through.max(0), out=second)
        ids = np.array(path[::-1], "<i4").reshape(len(path), len(words)).T
        counts = 4 * (ids >= 0).sum(1)
        raw, ends = np.ascontiguousarray(ids).tobytes(), (rows + 1) * (4 * len(path))
        with np.errstate(invalid="ignore"):
            loss = second - best[size]
        return [
            raw[e - c : e] if ok else None for e, c, ok in zip(ends.tolist(), counts.tolist(), plain.tolist(), strict=True)
        ], best[size].tolist(), loss.tolist()

    def _found(self, part: str) -> tuple[bytes, tuple[tuple[float, bytes], ...], float, bool]:
        """Of a part of a word: ids of its best segmentation, losses and ids of the others of the n best, its score, if it decodes."""
        found = self.search(part)
        score, ids = found[0]
        others = tuple([(s - score, x.tobytes()) for s, x in found[1:]])
        return ids.tobytes(), others, score, self.spelled(ids) == part.replace(SPACE, " ").replace(_PRIVATE, SPACE)

    def _parts(self, word: str) -> tuple[bytes, tuple[tuple[float, bytes], ...], float, bool]:
        """As _found, for a word in parts that no piece crosses."""
        parts = [self._found(p) for p in self.pattern.findall("\n" + word[1:] if word[:1] == _LINE else SPACE + word)]
        some = [(0.0, None)]  # loss, and a chain of the parts that are not as in the best: the one before, place and ids
        for at, (_, more, _, _) in enumerate(parts):
            if more:
                some = heapq.nlargest(self.n, [(a + b, (x, at, y) if y else x) for a, x in some for b, y in ((0.0, None), *more)], key=itemgetter(0))
        own, others = [p[0] for p in parts], []
        for loss, chain in some[1:]:
            ids = own.copy()
            while chain:
                chain, at, ids[at] = chain
            others.append((loss, b"".join(ids)))
        return b"".join(own), tuple(others), sum(p[2] for p in parts), all(p[3] for p in parts)

    def _learn(self, words) -> None:
        """Search words not seen before (forget all, if there are none). Of words that the arrays hold, the queue is left to when a text's n best need it."""
        if not words:
            self.seen, self.ids, self.others, self.sums, self.held = {}, [], [], np.zeros((3, 0)), 0
        rows, by_size = [], defaultdict(list)
        line = array("i", [self.bytes[10]]).tobytes()
        for word in words:
            size = len(word) + (word[:1] != _LINE) - (word[:1] == _LINE)
            by_size[size if size < 48 else 0].append(word)
        rest = by_size.pop(0, [])
        for size, group in by_size.items():
            for word, ids, score, loss in zip(group, *self._many([w[1:] if w[:1] == _LINE else SPACE + w for w in group], size), strict=True):
                if ids is None:
                    rest.append(word)
                elif word[:1] == _LINE:
                    rows.append((word, line + ids, None, score + self.byte_score, loss, True))
                else:
                    rows.append((word, ids, None, score, loss, True))
        for word in rest:
            ids, others, score, same = self._parts(word)
            rows.append((word, ids, others, score, others[0][0] if others else -math.inf, same))
        if rows:
            words, ids, others, *sums = zip(*rows, strict=True)
            self.seen.update(zip(words, range(len(self.ids), len(self.ids) + len(rows)), strict=True))
            self.ids += ids
            self.others += others
            self.sums = np.concatenate([self.sums, np.array(sums, float)], 1)

    def _others(self, word: str, at: int) -> tuple[tuple[float, bytes], ...]:
        if self.others[at] is None:
            self.others[at] = self._parts(word)[1]
        return self.others[at]

    def encode(self, texts: list[str]):
        """For each text: ids of the best segmentation as 4-byte integers, scores of the n best, and if the ids decode to the text."""
        for ids, scores, same in self.n_best(texts):
            yield ids[0], scores, same

    def n_best(self, texts: list[str]):
        """For each text, best first: ids of the n best segmentations as 4-byte integers, their scores, and if the best decodes to the text."""
        split = [self.chunks(t) for t in texts]
        if len(self.seen) > CACHE or self.held > LETTERS:
            self._learn(())
        new = set().union(*split).difference(self.seen)
        self.held += sum(map(len, new))
        if new:
            self._learn(new)
        for words in split:
            at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
            first = self.sums[1].take(at)
            deltas = [(0.0, ())]  # loss, and the words that are not as in the best: place and ids
            # only the words with the least first loss can be in one of the n best
            for i in np.argpartition(-first, self.n)[: self.n] if len(at) > self.n else range(len(at)):
                more = ((0.0, None), *self._others(words[i], at[i]))
                deltas = heapq.nlargest(self.n, [(a + b, (*x, (i, y)) if y else x) for a, x in deltas for b, y in more], key=itemgetter(0))
            score, own, found = float(self.sums[0].take(at).sum()), list(map(self.ids.__getitem__, at.tolist())), []
            for _, swaps in deltas:
                ids = own.copy() if swaps else own
                for i, other in swaps:
                    ids[i] = other
                found.append(b"".join(ids))
            yield found, [score + d for d, _ in deltas], bool(self.sums[2].take(at).all())

    def spelled(self, ids) -> str:
        """What the ids spell, with the space before the first word."""
        try:
            return "".join([self.texts[i] for i in ids])
        except KeyError:  # bytes are among them
            pass
        out, raw, lowest = [], bytearray(), self.bytes[0]
        for i in ids:
            if lowest <= i < lowest + 256:
                raw.append(i - lowest)
                continue
            out += [raw.decode(errors="surrogatepass"), self.texts[i]]
            raw = bytearray()
        return "".join([*out, raw.decode(errors="surrogatepass")])

    def decode(self, ids) -> str:
        return self.spelled(ids)[1:]


def encode(docs: DataFrame, path: str, n_best: int = 3, with_ids: bool = True) -> DataFrame:
    """The n best segmentations of every row of docs(doc_id, text).

    Returns doc_id, n_pieces, ids (null unless with_ids), ids_sha256 (of the ids as little-endian 4-byte integers),
    score, nbest_scores (best first), round_trip (whether decoding the ids gives the text), nbest_ids (null unless with_ids)
    and nbest_sha256.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
    names = ["doc_id", "n_pieces", "ids", "ids_sha256", "score", "nbest_scores", "round_trip", "nbest_ids", "nbest_sha256"]

    def run(batches):
        shared = model.value  # a worker lets go of it, and so of the lattice, when it turns to other work
        if "lattice" not in shared:
            shared["lattice"] = Lattice(shared, n_best)
        lattice = shared["lattice"]
        for batch, texts in text_chunks(batches):
            rows = []
            for doc_id, (raws, scores, same) in zip(batch.column("doc_id").to_pylist(), lattice.n_best(texts), strict=True):
                ids, digests = [np.frombuffer(x, "<i4") for x in raws] if with_ids else None, [hashlib.sha256(x).hexdigest() for x in raws]
                rows.append((doc_id, len(raws[0]) // 4, ids and ids[0], digests[0], scores[0], scores, same, ids, digests))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_pieces long, ids array<int>, ids_sha256 string, score double, nbest_scores array<double>, round_trip boolean, "
        "nbest_ids array<array<int>>, nbest_sha256 array<string>"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of encoded(doc_id, ids); null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        lattice = Lattice(model.value, 1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([lattice.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())],
                names=["doc_id", "text"]
            )

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
