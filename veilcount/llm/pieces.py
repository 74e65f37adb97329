"""Operator 10: SentencePiece encoding and decoding with exact N-best segmentations.

A text's lattice has an edge for every vocabulary piece that fits somewhere; a
segmentation's score is the sum of its pieces' scores. A forward Viterbi pass
gives the best score from the start to every position. Those scores are exact
heuristics for a search from the end backwards: A* pops complete segmentations
in the order of their scores.

No piece reaches over the start of a word (a run of spaces and what follows) or
over a character that no piece holds, so a text's lattice is a chain of word
lattices. The forward pass runs over all distinct words of a block at once; the
A* search runs on those words whose alternatives can be among a text's N best,
and the texts' segmentations are merged from those of their words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import Roller, U, mix
from .shared import give_back, pack, unpack, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Stands for U+2581 in a text, which must not be taken for a space. It is the last code point, a noncharacter;
#: a text that holds that one itself gets it back as U+2581.
OWN_MARK = 0x10FFFF
#: Characters handled at once, and the longest word that is handled with others.
BLOCK, LONG = 1 << 20, 64
COMMON = 128
N_BEST = 4
NEVER = -1e30


class Vocabulary:
    """Pieces, scores and the trie over their characters."""

    def __init__(self, pieces: list[str | bytes | None], scores: list[float]):
        """``pieces[i]``: text of piece i, one byte for a byte piece, None for control and unknown."""
        self.bytes_id = {p[0]: i for i, p in enumerate(pieces) if isinstance(p, bytes)}
        real = [(p, i) for i, p in enumerate(pieces) if isinstance(p, str) and p]
        usual = [scores[i] for _, i in real if scores[i] > -1e8]
        self.unknown = min(usual, default=0.0) - 10
        self.scores = scores
        self.text_id = dict(real)
        self.longest = max((len(p) for p, _ in real), default=1)
        counts: dict[str, int] = {}
        for p, _ in real:
            for c in p:
                counts[c] = counts.get(c, 0) + 1
        order = sorted(counts, key=lambda c: (-counts[c], c))
        #: Class of each code point; 0 for those in no piece.
        self.class_of = np.zeros(OWN_MARK + 1, np.int32)
        for k, c in enumerate(order):
            self.class_of[ord(c)] = k + 1
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for p, i in real:
            at = 0
            for c in p:
                k = int(self.class_of[ord(c)])
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][k]
            ends[at] = i
        self.ends = np.array(ends)
        self.end_score = np.where(self.ends >= 0, np.array(scores)[self.ends], NEVER)
        #: Next state by state and class: a table for common classes, sorted keys for the others; -1: none.
        self.table = np.full((len(children), COMMON), -1, np.int32)
        rare = []
        for at, kids in enumerate(children):
            for k, to in kids.items():
                if k < COMMON:
                    self.table[at, k] = to
                else:
                    rare.append((at << 32 | k, to))
        rare.sort()
        self.rare_key, self.rare_to = np.array([x for x, _ in rare] or [-1]), np.array([x for _, x in rare] or [-1])
        spelled = [p if isinstance(p, bytes) else (p or "").replace("▁", " ").encode() for p in pieces]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.cumsum([0, *map(len, spelled)])

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = self.table[state, np.minimum(kind, COMMON - 1)]
        out = np.where(kind < COMMON, out, -1)
        odd = np.flatnonzero(kind >= COMMON)
        if len(odd):
            key = state[odd].astype(np.int64) << 32 | kind[odd]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            out[odd] = np.where(self.rare_key[at] == key, self.rare_to[at], -1)
        return out

    def edges(self, word: str, at: int) -> Iterator[tuple[int, int, float]]:
        """(end, piece or -1, score) of the edges that start at a position."""
        one = False
        for end in range(at + 1, min(len(word), at + self.longest) + 1):
            piece = self.text_id.get(word[at:end])
            if piece is not None:
                one |= end == at + 1
                yield end, piece, self.scores[piece]
        if not one:
            yield at + 1, -1, self.unknown

    def spell_unknown(self, code: int) -> list[int]:
        return [self.bytes_id[b] for b in chr(SPACE if code == OWN_MARK else code).encode()]

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first; of equal scores any order of equals, but always the same."""
        best = [0.0] + [NEVER] * len(word)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(word) + 1)]
        for at in range(len(word)):
            for end, piece, score in self.edges(word, at):
                into[end].append((at, piece, score))
                best[end] = max(best[end], best[at] + score)
        heap, count, out = [(-best[-1], 0, len(word), 0.0, None)], 0, []
        while heap and len(out) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    piece, code, path = path
                    ids += [piece] if piece >= 0 else self.spell_unknown(code)
                out.append((behind, ids))
                continue
            for start, piece, score in into[at]:
                count += 1
                heapq.heappush(heap, (-(best[start] + score + behind), count, start, score + behind, (piece, ord(word[start]), path)))
        return out

    def viterbi(self, kinds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of one length: (best score, second best, pieces of each word in a row, number of pieces).

        Pieces of unknown characters are -1 - code. Of equal scores the
        longer last piece wins.
        """
        n, length = kinds.shape
        first = np.full((length + 1, n), NEVER)
        second = np.full((length + 1, n), NEVER)
        first[0] = 0
        back = np.zeros((length + 1, n), np.int16)
        made = np.full((length + 1, n), -1, np.int64)
        for at in range(length):
            words, state = np.arange(n), np.zeros(n, np.int32)
            for end in range(at + 1, min(length, at + self.longest) + 1):
                state = self.step(state, kinds[words, end - 1])
                score = np.where(state >= 0, self.end_score[state], NEVER)
                piece = self.ends[state]
                if end == at + 1:
                    lost = score <= NEVER
                    score = np.where(lost, self.unknown, score)
                    piece = np.where(lost, -1 - codes[words, at], piece)
                hit = np.flatnonzero(score > NEVER)
                if len(hit):
                    w = words[hit]
                    a, b = first[at, w] + score[hit], np.maximum(second[at, w] + score[hit], NEVER)
                    old = first[end, w]
                    second[end, w] = np.maximum(np.minimum(old, a), np.maximum(second[end, w], b))
                    better = a > old
                    first[end, w[better]] = a[better]
                    back[end, w[better]] = at
                    made[end, w[better]] = piece[hit][better]
                live = state >= 0
                words, state = words[live], state[live]
                if not len(words):
                    break
        ids = np.zeros((n, length), np.int64)
        count = np.zeros(n, np.int64)
        at = np.full(n, length)
        for _ in range(length):
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            count[live] += 1
            ids[live, length - count[live]] = made[at[live], live]
            at[live] = back[at[live], live]
        return first[-1], second[-1], ids, count


def load_vocabulary(path: str = MODEL) -> tuple[list[str | bytes | None], list[float]]:
    """Pieces and scores of a model file that the driver can read."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[str | bytes | None] = []
    for i in range(model.vocab_size()):
        text = model.id_to_piece(i)
        pieces.append(bytes([int(text[3:5], 16)]) if model.is_byte(i) else None if model.is_control(i) or model.is_unknown(i) else text)
    return pieces, [model.get_score(i) for i in range(model.vocab_size())]


@lru_cache(maxsize=2)
def vocabulary(pieces: tuple, scores: tuple) -> Vocabulary:
    return Vocabulary(list(pieces), list(scores))


def ragged(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the given rows of a ragged array."""
    size = at[rows + 1] - at[rows]
    skip = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return size, flat[np.repeat(at[rows], size) + skip]


class Words:
    """The distinct words of a block: best ids, best and second scores."""

    def __init__(self, voc: Vocabulary, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.voc, self.codes, self.start, self.end = voc, codes, start, end
        size = end - start
        n = len(start)
        self.best, self.second = np.zeros(n), np.full(n, NEVER)
        kinds = voc.class_of[codes]
        owner, parts = [], []
        for length in np.unique(size[size <= LONG]).tolist():
            mine = np.flatnonzero(size == length)
            for at in range(0, len(mine), 8192):
                own = mine[at : at + 8192]
                grid = start[own][:, None] + np.arange(length)
                best, second, ids, count = voc.viterbi(kinds[grid], codes[grid])
                self.best[own], self.second[own] = best, second
                inside = np.arange(length)[None] >= length - count[:, None]
                owner.append(np.repeat(own, count))
                parts.append(ids[inside])
        for i in np.flatnonzero(size > LONG).tolist():
            found = voc.n_best(self.text(i), 2)
            self.best[i] = found[0][0]
            self.second[i] = found[1][0] if len(found) > 1 else NEVER
            owner.append(np.full(len(found[0][1]), i))
            parts.append(np.array(found[0][1], np.int64))
        who = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # an unknown character is spelled as its bytes
        odd = np.flatnonzero(flat < 0)
        spelled = [voc.spell_unknown(-1 - x) for x in flat[odd].tolist()]
        sizes = np.ones(len(flat), np.int64)
        sizes[odd] = [len(x) for x in spelled]
        place = (np.cumsum(sizes) - sizes)[odd].tolist()
        who, flat = np.repeat(who, sizes), np.repeat(flat, sizes)
        for at, ids in zip(place, spelled, strict=True):
            flat[at : at + len(ids)] = ids
        order = np.argsort(who, kind="stable")
        self.flat = flat[order]
        counts = np.bincount(who, minlength=n)
        self.at = np.concatenate([[0], np.cumsum(counts)])

    def text(self, i: int) -> str:
        return "".join("﷐" if c == OWN_MARK else chr(c) for c in self.codes[self.start[i] : self.end[i]].tolist())

    @lru_cache(maxsize=4096)
    def others(self, i: int, n: int) -> list[tuple[float, np.ndarray]]:
        """The next n segmentations of a word after the best: how much worse each is, and its ids."""
        best = ragged(self.flat, self.at, np.array([i]))[1].tolist()
        found = self.voc.n_best(self.text(i), n + 1)
        # the best one may be another of equal score here
        at = next((k for k, (_, ids) in enumerate(found) if ids == best), len(found) - 1)
        return [(max(0.0, float(self.best[i]) - s), np.array(ids, np.int32)) for k, (s, ids) in enumerate(found) if k != at]


def merged(others: list[list[float]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n smallest sums of one loss (or 0) from each list, without the sum of nothing, each with (list, place) of its losses."""
    sums: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for j, own in enumerate(others):
        more = [(a + x, took + ((j, k),)) for a, took in sums for k, x in enumerate(own)]
        sums = heapq.nsmallest(n + 1, sums + more, key=lambda x: (x[0], len(x[1])))
    return sums[1:]


def encode_block(voc: Vocabulary, texts: list[str], n: int) -> tuple[list[np.ndarray], list[list[float]]]:
    """Best ids and the scores of the n best segmentations of each text."""
    lists, scores = n_best_block(voc, texts, n)
    return [x[0] for x in lists], scores


def n_best_block(voc: Vocabulary, texts: list[str], n: int) -> tuple[list[list[np.ndarray]], list[list[float]]]:
    """Ids and scores of the n best segmentations of each text, best first."""
    own = [len(t) for t in texts]
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32)
    raw = np.where(raw == SPACE, OWN_MARK, np.where(raw == 0x20, SPACE, raw))
    used = np.array([i for i, x in enumerate(own) if x], np.int64)
    at = np.cumsum([0, *own])[:-1][used]
    # every text that isn't empty gets a space in front
    codes = np.insert(raw, at, SPACE)
    first = at + np.arange(len(at))
    alone = voc.class_of[codes] == 0
    begin = np.zeros(len(codes), bool)
    begin[1:] = ((codes[1:] == SPACE) & (codes[:-1] != SPACE)) | alone[1:] | alone[:-1]
    begin[first] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(codes)) if len(start) else start
    roller = Roller(mix(codes.astype(U) + U(1)))
    key = roller.span(start, end) ^ (end - start).astype(U)
    order = np.argsort(key)
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    kind = np.empty(len(key), np.int64)
    kind[order] = np.cumsum(head) - 1
    some = order[head]
    words = Words(voc, codes, start[some], end[some])
    gap = words.best - words.second
    cut = np.append(np.searchsorted(start, first), len(start))
    ids: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in texts]
    scores: list[list[float]] = [[0.0] if not x else [] for x in own]
    for j, i in enumerate(used.tolist()):
        mine = kind[cut[j] : cut[j + 1]]
        sizes, best = ragged(words.flat, words.at, mine)
        best = best.astype(np.int32)
        ids[i] = [best]
        total = float(words.best[mine].sum())
        near = np.arange(len(mine))
        if len(mine) > n - 1 > 0:
            near = np.sort(np.argpartition(gap[mine], n - 2)[: n - 1])
        near = [int(k) for k in near if gap[mine[k]] < -NEVER / 2] if n > 1 else []
        others = [words.others(int(mine[k]), n - 1) for k in near]
        ends = np.cumsum(sizes)[near].tolist() if near else []
        begins = [e - z for e, z in zip(ends, sizes[near].tolist(), strict=True)] if near else []
        chosen = merged([[x for x, _ in own] for own in others], n - 1)[: n - 1] if near else []
        for _, took in chosen:
            parts, done = [], 0
            for j, k in took:
                parts += [best[done : begins[j]], others[j][k][1]]
                done = ends[j]
            ids[i].append(np.concatenate([*parts, best[done:]]))
        scores[i] = [total, *(total - x for x, _ in chosen)]
    return ids, scores


def decode_ids(voc: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of a list of ids: exact inverse of encoding."""
    spelled = ragged(voc.spelled, voc.spelled_at, ids.astype(np.int64))[1].tobytes()
    return spelled[1:] if spelled[:1] == b" " else spelled


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > BLOCK:
            yield at, i
            at, n = i, 0
        n += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, carry: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """doc_id, the carried columns, ``n_best``, ``ids`` and ``scores`` of every text.

    ``n_best`` holds the ids and the score of the ``n_best`` best segmentations,
    best first (fewer, if the lattice has fewer paths; of equal scores any
    order, but always the same); ``ids`` are those of the best, ``scores`` the
    scores of all. A text gets a space in front and spaces are spelled as the
    mark U+2581; the mark itself and characters in no piece are spelled as
    bytes, so decoding any of them gives back every text exactly. An empty text
    has no ids and the score 0 of its one empty path; a null text has null in
    all. Repeated rows are encoded each, very long texts as a whole. A carried
    column with an output's name comes back with ``_given`` behind it. The model
    file is read by the driver.
    With ``check`` every segmentation is decoded again at once, and
    ``round_trip`` tells whether the text came back from all.
    """
    pieces, scores = (tuple(x) for x in load_vocabulary(model))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(pieces, scores)
        for b in batches:
            texts = b["text"].to_pylist()
            for i, j in blocks(texts):
                part = b.slice(i, j - i)
                lists, best = n_best_block(voc, [t or "" for t in texts[i:j]], n_best)
                gone = np.array([t is None for t in texts[i:j]])
                # all segmentations of the block stand in a row; null texts must have none there
                for k in np.flatnonzero(gone).tolist():
                    lists[k], best[k] = [], []
                first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                flat = [ids for own in lists for ids in own]
                spans = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32))
                every = pa.ListArray.from_arrays(spans, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))
                score = pa.array([x for own in best for x in own], pa.float64())
                offsets = pa.array(first.astype(np.int32), mask=np.append(gone, False))
                ranked = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([every, score], ["ids", "score"]))
                id_lists = every.take(pa.array(first[:-1], mask=gone))
                score_lists = pa.ListArray.from_arrays(offsets, score)
                same = [pa.array([t is None or all(decode_ids(voc, x) == t.encode() for x in own) for t, own in zip(texts[i:j], lists, strict=True)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, ranked, id_lists, score_lists, *same], [*part.schema.names, *own])
                del lists, flat, best, every, ranked, id_lists, score_lists
                give_back()

    own = ("n_best", "ids", "scores", *["round_trip"] * check)
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), pack(carry))
    out = given.mapInArrow(job, with_fields(given, "n_best array<struct<ids: array<int>, score: double>>, ids array<int>, scores array<double>" + ", round_trip boolean" * check))
    return out.select("doc_id", *unpack(tuple(c for c in carry if c != "doc_id"), own), *own)


def decode(rows: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and ``decoded``, the text of each row's ``ids`` (null for null)."""
    pieces, scores = (tuple(x) for x in load_vocabulary(model))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(pieces, scores)
        for b in batches:
            lists = b["ids"]
            at, flat, gone = np.asarray(lists.offsets), np.asarray(lists.values), np.asarray(lists.is_null())
            out = [None if g else decode_ids(voc, flat[i:j]).decode(errors="replace") for i, j, g in zip(at[:-1].tolist(), at[1:].tolist(), gone.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carry), pa.array(out, pa.string())], [*carry, "decoded"])

    given = rows.select(*carry, *(["ids"] if "ids" not in carry else []))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.select(*carry).schema)
    return given.mapInArrow(job, schema + "decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text survives encoding and decoding by all its segmentations, and what their ids and scores are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.xxhash64("n_best.ids").alias("n_best_hash"), F.transform("scores", lambda x: F.round(x, 3)).alias("scores"), "round_trip")
