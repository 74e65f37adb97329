"""Operator 13: licence notices, also with typing errors.

A notice that may have k errors is split into k + 1 pieces. Wherever it stands
with no more errors, one of its pieces stands unchanged, and at most k places
from where it belongs. All pieces are searched in one pass (Aho-Corasick); a
hit is a candidate if words begin and end where the notice would have to, and
the regex library's bounded-error matching then tells the errors and the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import text_views

#: Text that is split into words at a time, and verified candidates that a task remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 14
#: Digits, letters and all bytes of longer characters are inside a word; A-Z becomes a-z.
_fold = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Notice:
    """``words``: in lower case with one space between; words in brackets must stand unchanged. ``errors``: how many letters may be changed, left out or put in."""

    label: str
    words: str
    errors: int

    @property
    def text(self) -> str:
        return re.sub(r"[\[\]]", "", self.words)

    @property
    def pattern(self) -> regex.Pattern:
        parts = [p for p in re.split(r"(\[[^\]]*\])", self.words) if p]
        inner = "".join(regex.escape(p[1:-1]) if p[0] == "[" else f"(?:{regex.escape(p)}){{e<={self.errors}}}" for p in parts)
        return regex.compile(rf"(?b)(?<![^ ]){inner}(?![^ ])")

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): one more than there may be errors."""
        n = self.errors + 1
        return [(a, self.text[a:b]) for a, b in pairwise(len(self.text) * i // n for i in range(n + 1))]


#: The phrases of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Sentences that licences are known by.
NOTICES = (
    Notice("mit", "under the [mit] license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8),
    Notice("apache-2", "[apache] license version [2]", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("gpl", "[gnu] general public license", 2),
    Notice("lgpl", "gnu [lesser] general public license", 3),
    Notice("agpl", "gnu [affero] general public license", 3),
    Notice("mpl-2", "[mozilla] public license version [2]", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 8),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
)


class Scanner:
    """All pieces and phrases in one automaton."""

    def __init__(self, notices: tuple[Notice, ...], phrases: tuple[tuple[str, str], ...]):
        self.notices, self.phrases = notices, phrases
        self.patterns = [n.pattern for n in notices]
        self.sizes = [len(n.text) for n in notices]
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        found: dict[str, list[tuple[int, int, int]]] = {}
        for i, (phrase, _) in enumerate(phrases):
            found.setdefault(f" {phrase} ", []).append((-1 - i, 0, len(phrase) + 2))
        for i, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                found.setdefault(piece, []).append((i, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for text, entries in found.items():
            self.automaton.add_word(text, tuple(entries))
        if found:
            self.automaton.make_automaton()

    @staticmethod
    def line(text: np.ndarray) -> tuple[int, str]:
        """(words, the words with one space before, between and after them)."""
        whole, at, n, out = bytes(text).translate(_fold), 0, 0, [b""]
        while at < len(whole):
            end = whole.find(b" ", at + SLICE)
            end = len(whole) if end < 0 else end
            words = whole[at:end].split()
            n += len(words)
            if words:
                out.append(b" ".join(words))
            at = end
        return n, b" ".join([*out, b""]).decode("utf-8", "replace")

    def verified(self, notice: int, segment: str) -> tuple[int, int, int] | None:
        """(start, end, errors) of the notice's best match within a text that begins and ends with words."""
        key = notice, segment
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            m = self.patterns[notice].search(segment)
            good = m is not None and sum(m.fuzzy_counts) <= self.notices[notice].errors
            self.known[key] = (m.start(), m.end(), sum(m.fuzzy_counts)) if good else None
        return self.known[key]

    def scan(self, text: np.ndarray) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """(words, places of phrases as (word, label), matches as (notice, first word, last word, errors)), each in order."""
        words, line = self.line(text)
        places: list[tuple[int, str]] = []
        candidates: set[tuple[int, int]] = set()
        if words and len(self.automaton):
            for end, entries in self.automaton.iter(line):
                for which, offset, size in entries:
                    at = end + 1 - size
                    if which < 0:
                        places.append((at + 1, self.phrases[-1 - which][1]))
                    else:
                        candidates.add((which, at - offset))
        spans: list[tuple[int, int, int, int]] = []
        for which, at in sorted(candidates):
            k, size = self.notices[which].errors, self.sizes[which]
            first = line.find(" ", max(0, at - k - 1), max(0, at + k)) + 1
            end = line.rfind(" ", max(0, at + size - k), at + size + k + 1)
            if not 0 < first < end:
                continue
            hit = self.verified(which, line[first:end])
            if hit is None:
                continue
            span = which, first + hit[0], first + hit[1], hit[2]
            if spans and spans[-1][0] == which and span[1] < spans[-1][2]:
                # the same place once more
                if span[3] < spans[-1][3]:
                    spans[-1] = span
            else:
                spans.append(span)
        # letters become words
        wanted = sorted({at for at, _ in places} | {at for s in spans for at in (s[1], s[2] - 1)})
        word, last, at_word = -1, 0, {}
        for at in wanted:
            word += line.count(" ", last, at)
            last, at_word[at] = at, word
        return words, sorted((at_word[at], label) for at, label in places), [(n, at_word[a], at_word[b - 1], e) for n, a, b, e in spans]


SPAN = pa.struct({"label": pa.string(), "notice": pa.string(), "first_word": pa.int64(), "last_word": pa.int64(), "errors": pa.int32()})


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are about
    phrases that stand word by word; ``labels`` adds those of notices with at
    most their number of errors, whose ``spans`` are given. ``score`` is 1 with
    a phrase, else the share of right letters of the best notice, 0 without
    any. Null and empty texts have no words. Whole texts are scanned, also very
    long ones; repeated rows are scanned each; other columns are left out, so
    their names cannot clash. An empty table gives no row.
    """
    if any(n.errors < 0 or n.errors >= len(n.text) for n in notices):
        raise ValueError("a notice needs more letters than it may have errors")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for b in batches:
            rows = []
            for text in text_views(pa.chunked_array([b["text"]])):
                words, places, matches = scanner.scan(text)
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(notices[n].label for n, *_ in matches)})
                score = 1.0 if places else max((1 - e / scanner.sizes[n] for n, _, _, e in matches), default=0.0)
                spans = [{"label": notices[n].label, "notice": notices[n].text, "first_word": f, "last_word": t, "errors": e} for n, f, t, e in matches]
                rows.append((words, len(places), places[0][0] if places else None, places[-1][0] if places else None, base, labels, score, spans))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(SPAN))
            yield pa.record_batch([b["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, errors: int>>")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
