"""License scans: exact phrases by word, and fuzzy short notices by pigeonhole seeds and the regex library's bounded errors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, byte_column, in_arrow

#: Base phrases and their labels: fixed values.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Short notices found with some edits, and the labels they add.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version": "apache",
    "licensed under the gnu general public license": "gpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "permissive-grant",
    "this work is licensed under a creative commons": "creative-commons",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "rights-reserved",
    "the software is provided as is without warranty of any kind": "no-warranty",
    "spdx license identifier": "spdx",
}
#: One edit for each so many characters of a notice.
CHARS_PER_EDIT = 10


@cache
def _notices(notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, list[tuple[bytes, int]], regex.Pattern]]:
    """(text, edits, [(seed, its place)], pattern): of edits + 1 disjoint seeds one stands unedited; the pattern counts the fewest edits."""
    out = []
    for text in filter(None, dict(notices)):
        edits = len(text) // CHARS_PER_EDIT
        cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
        seeds = [(text[s:e].encode(), s) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        out.append((text, edits, seeds, regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}")))
    return out


def places(line: bytes, needle: bytes) -> Iterator[int]:
    at = line.find(needle)
    while at >= 0:
        yield at
        at = line.find(needle, at + 1)


def word_numbers(line: bytes, blanks: Iterable[int]) -> Iterator[int]:
    """The number of the word behind each of the rising places of blanks; ``line`` opens with a blank."""
    n, last = -1, 0
    for at in blanks:
        n, last = n + line.count(b" ", last, at + 1), at + 1
        yield n


def scan(text: bytes | None, phrases: dict[str, str], notices: dict[str, str]) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, str]]]:
    """(words, [(first word, label)], [(notice, first word, words, edits, matched text)])."""
    words = text.translate(WORDS).split() if text else []
    line = b" " + b" ".join(words) + b" "
    base = [(word, label) for phrase, label in phrases.items() for word in word_numbers(line, places(line, b" %s " % phrase.encode()))]
    found = []
    for notice, edits, seeds, pattern in _notices(tuple(notices.items())):
        windows: list[list[int]] = []
        for at, place in sorted((at, place) for seed, place in seeds for at in places(line, seed)):
            low, high = max(0, at - place - 4 * edits), at - place + len(notice) + 4 * edits  # an edit's character has 4 bytes at most
            if windows and low <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], high)
            else:
                windows.append([low, high])
        # a window is cut at blanks, so that no character is cut and no word counts in part
        lows = [line.rfind(b" ", 0, low + 1) for low, _ in windows]
        for (_, high), low, word in zip(windows, lows, word_numbers(line, lows), strict=True):
            low, high = low + 1, line.find(b" ", high)
            part = line[low : high if high >= 0 else len(line) - 1].decode("utf-8", "replace")
            own = part.split(" ")
            found += [(notice, word + at, n, e, " ".join(own[at : at + n])) for at, n, e in spans(part, len(notice), edits, pattern)]
    return len(words), sorted(base), sorted(set(found), key=lambda f: (f[1], f[0]))


def spans(part: str, length: int, edits: int, pattern: regex.Pattern) -> list[tuple[int, int, int]]:
    """(first word, words, edits) of the spans of whole words within ``edits`` of a notice; of those that overlap the
    nearest, then the one of most like length, then the first.

    Each span of whole words that is long enough and not too long is held whole against the pattern, so
    that a match which would end inside a word hides no other.
    """
    start = [0, *(i + 1 for i, c in enumerate(part) if c == " ")]
    stop = [*(i - 1 for i in start[1:]), len(part)]
    near, last = [], 0
    for i, s in enumerate(start):
        last = max(last, i)
        while last < len(stop) and stop[last] - s < length - edits:
            last += 1
        for j in range(last, len(stop)):
            if stop[j] - s > length + edits:
                break
            if m := pattern.fullmatch(part, s, stop[j]):
                near.append((sum(m.fuzzy_counts), abs(stop[j] - s - length), i, j - i + 1))
    out, taken = [], set()
    for e, _, at, n in sorted(near):
        if taken.isdisjoint(range(at, at + n)):
            taken.update(range(at, at + n))
            out.append((at, n, e))
    return out


SCHEMA = "n_words long, base array<struct<word:bigint,label:string>>, notices array<struct<notice:string,label:string,word:bigint,words:bigint,edits:bigint,text:string>>"


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, base, notices of every whole text, without a shuffle.

    A-Z is lower-cased; words are runs of digits, a-z and non-ASCII characters.  ``base`` has each place
    where a phrase's words stand in a row; ``notices`` each span that is a notice with at most one edit
    for CHARS_PER_EDIT of its characters, whole words, with the edits and the text met (of spans that
    overlap, the nearest).  A null text is an empty one: no words, nothing found; a very long one is
    scanned whole.  Repeated rows are scanned each; other columns aren't read.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    kind = pa.struct([("word", pa.int64()), ("label", pa.string())])
    fuzzy = pa.struct([("notice", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t, phrases, notices) for _, part in byte_column(batch, "text") for t in part]
            base = [[{"word": w, "label": label} for w, label in r[1]] for r in rows]
            near = [[dict(zip(("notice", "label", "word", "words", "edits", "text"), (n, notices[n], w, k, e, t), strict=True)) for n, w, k, e, t in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(base, pa.list_(kind)), pa.array(near, pa.list_(fuzzy))], ["doc_id", "n_words", "base", "notices"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, f"doc_id long, {SCHEMA}")


def license_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a base phrase stands, else 1 less the share of edited characters in the best
    notice, else 0.
    """
    found = license_scan(docs, **options)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("base", lambda b: b["label"])
    word = F.transform("base", lambda b: b["word"])
    close = F.array_max(F.transform("notices", lambda n: 1 - n["edits"] / F.length(n["notice"])))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("notices", lambda n: n["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(close, F.lit(0.0))).alias("score"), "notices",
    )
