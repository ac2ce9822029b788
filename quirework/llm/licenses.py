"""License scan: ordered signature rules behind a keyword prefilter.

Texts are lower-cased (A-Z only). One Aho-Corasick pass finds the keywords that occur; only rules of
which a keyword occurs run their regex, and every match of a rule holds one of its keywords. Every match is a detection with the rule's priority (its place in the
list). A detection that lies inside another one of the same or a higher priority is suppressed; equal
intervals keep the rule of the highest priority. Base phrases are found word by word beside the rules,
at every place, and their labels are never suppressed.

Cases: null and empty texts have no words and no labels and score 0; repeated rows are scanned each;
texts of any length are scanned whole; other columns are not read; an empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.llm import license_rules
from quirework.llm.text_bytes import bounded, utf8, word_spans

# Phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_WEIGHT = 0.5

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<start:int,end:int,label:string>>"
)
Detection = tuple[int, int, int]


def resolve(found: list[Detection], priorities: int) -> list[Detection]:
    """Detections ``(start, end, priority)`` without those inside another of the same or a higher priority."""
    import numpy as np

    kept: list[Detection] = []
    reach = np.full(priorities, -1)  # furthest end so far among detections of this or a higher priority
    for start, end, priority in sorted(found, key=lambda d: (d[0], -d[1], d[2])):
        # by this order whatever contains the interval stands before it
        if reach[priority] < end:
            kept.append((start, end, priority))
            np.maximum(reach[priority:], end, out=reach[priority:])
    return kept


class Scanner:
    def __init__(self, rules: list[tuple[str, float, str, str]]) -> None:
        import ahocorasick

        self.rules, self.automaton = rules, ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for priority, rule in enumerate(rules):
            for keyword in rule[2].split("|"):
                by_keyword.setdefault(keyword, []).append(priority)
        for keyword, priorities in by_keyword.items():
            self.automaton.add_word(keyword, tuple(priorities))
        self.automaton.make_automaton()
        self.compiled: dict[int, re.Pattern] = {}
        self.word = re.compile(f"{WORD}+")
        self.base = [(max(p.split(), key=len), re.compile(f"(?<!{WORD}){GAP.join(p.split())}(?!{WORD})"), label) for p, label in PHRASES]

    def rule_matches(self, text: str) -> list[Detection]:
        found = []
        for priority in {p for priorities in {value for _, value in self.automaton.iter(text)} for p in priorities}:
            if priority not in self.compiled:
                self.compiled[priority] = re.compile(self.rules[priority][3])
            found += [(*m.span(), priority) for m in self.compiled[priority].finditer(text)]
        return found

    def base_matches(self, text: str) -> list[tuple[int, str]]:
        return [
            (m.start(), label)
            for word, regex, label in self.base
            if word in text
            for m in regex.finditer(text)
        ]

    def words_before(self, text: str, at: int) -> int:
        return sum(1 for _ in self.word.finditer(text, 0, at))

    def row(self, text: str) -> tuple:
        detections = resolve(self.rule_matches(text), len(self.rules))
        base = self.base_matches(text)
        places = (min(p for p, _ in base), max(p for p, _ in base)) if base else ()
        first, last = (self.words_before(text, p) for p in places) if base else (None, None)
        base_labels = {label for _, label in base}
        weights = [self.rules[p][1] for _, _, p in detections] + [BASE_WEIGHT] * bool(base)
        labels = base_labels | {self.rules[p][0] for _, _, p in detections}
        spans = [{"start": s, "end": e, "label": self.rules[p][0]} for s, e, p in detections]
        return len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), max(weights, default=0.0), spans


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, float, str, str]] | None = None
) -> DataFrame:
    """One row per document; ``detections`` are character spans of the lower-cased text."""
    rules = license_rules.rules() if rules is None else rules

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        scanner = Scanner(rules)
        is_word = np.ones(256, bool)
        is_word[0x00:0x30] = is_word[0x3A:0x41] = is_word[0x5B:0x61] = is_word[0x7B:0x80] = False
        for batch in bounded(batches, 1):
            words = np.diff(word_spans(*utf8(batch.column(1)), is_word)[2])
            rows = [scanner.row(lower_ascii(text or "")) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), pa.array(words, pa.int64())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS]
            columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, COLUMNS)

    return docs.select(id_col, text_col).mapInArrow(scan, RESULT)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
