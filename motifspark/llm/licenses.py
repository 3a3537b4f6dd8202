"""Licence scan: exact phrases, and short notices with a bounded number of edits.

Fuzzy search is seed and verify. A notice that may differ by k edits is cut
into k + 1 pieces; by the pigeonhole principle one of them survives unchanged,
so exact search for the pieces finds every place worth a look. Around each
seed the regex library matches the whole notice with at most k edits and
reports its span. Texts are compared as words (A-Z lower-cased, joined by one
space), so line breaks and comment signs inside a notice do not matter.

Defined results: a null or empty text has no words, no places, null first and
last word, empty labels and score 0; repeated rows give repeated rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import ship

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice, label, edits allowed in characters.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("gnu general public license as published by the free software foundation", "gpl", 7),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 7),
    ("released under the mit license", "mit", 3),
)
#: Every byte that is not part of a word becomes a space; bytes from 0x80 are parts of words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LAST = ("first_word", "last_word")


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """The notice cut into edits + 1 pieces, each with its offset."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(cuts[i], notice[cuts[i] : cuts[i + 1]]) for i in range(n)]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: tuple):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(n.encode(), label, k, pieces(n.encode(), k), regex.compile(rb"(?b)(?:" + regex.escape(n.encode(), literal_spaces=True) + b"){e<=%d}" % k)) for n, label, k in notices]

    @staticmethod
    def words(text: str) -> tuple[bytes, int]:
        parts = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
        return b" " + b" ".join(parts) + b" " if parts else b"", len(parts)

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """(byte offset, label) of each place of each phrase; places may overlap."""
        found = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = joined.find(phrase, at + 1)
        return found

    def windows(self, joined: bytes, notice: bytes, edits: int, cut: list) -> list[tuple[int, int]]:
        """Merged ranges around the exact seeds, in which a match must lie."""
        seeds = []
        for offset, piece in cut:
            at = joined.find(piece)
            while at >= 0:
                seeds.append((max(0, at - offset - edits), min(len(joined), at - offset + len(notice) + edits)))
                at = joined.find(piece, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(seeds):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged]

    def fuzzy(self, joined: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, label, likeness) of each verified notice, byte offsets into joined."""
        found = []
        for notice, label, edits, cut, pattern in self.notices:
            for a, b in self.windows(joined, notice, edits, cut):
                # the best match of a range first, then what lies before and after it
                open_ = [(a, b)]
                while open_:
                    low, high = open_.pop()
                    if m := pattern.search(joined, low, high):
                        found.append((m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / len(notice)))
                        open_ += [(low, m.start()), (max(m.end(), low + 1), high)]
        return found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, exact places, labels and the verified fuzzy spans (in words)."""
    phrases = PHRASES if phrases is None else phrases
    ship(docs.sparkSession)

    def run(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", *_LAST, "base_labels", "labels", "score", "spans")}
            for text in batch.column(1).to_pylist():
                joined, n = scanner.words(text or "")
                base, fuzzy = scanner.base(joined), scanner.fuzzy(joined)
                word = lambda at, j=joined: j.count(b" ", 0, at + 1) - 1
                places = [at for at, _ in base]
                cols["n_words"].append(n)
                cols["n_base"].append(len(base))
                cols["first_word"].append(word(min(places)) if places else None)
                cols["last_word"].append(word(max(places)) if places else None)
                cols["base_labels"].append(",".join(sorted({x for _, x in base})))
                cols["labels"].append(",".join(sorted({x for _, x in base} | {x[2] for x in fuzzy})))
                cols["score"].append(1.0 if base else max([x[3] for x in fuzzy], default=0.0))
                cols["spans"].append([{"start": max(0, word(max(0, a - 1))), "end": word(max(0, b - 1)) + 1, "label": label, "score": s} for a, b, label, s in sorted(fuzzy)])
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items())], names=["doc_id", *cols])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,score:double>>")
