"""License scans: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from cliptide.llm.common import byte_texts, text_batches

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Markup: <<optional>> ... <</optional>> may be left out, <<var:N>> stands for up to N words, <<a|b>> for one of
# the alternatives. All other words are mandatory and must match one by one.
TEMPLATES = {
    "mit": [
        "<<licensed|available|distributed|provided|released>> under the <<optional>>terms of the<</optional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var:6>> and associated documentation files <<optional>>the <<var:4>><</optional>> "
        "to deal in the <<var:6>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var:6>>",
        "spdx license identifier mit",
    ],
    "apache-2": [
        "<<licensed|released|available|distributed>> under the <<optional>>terms of the<</optional>> apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>>",
        "licensed under the apache license version 2 0 the license you may not use this <<var:3>> except in compliance with the license",
        "spdx license identifier apache 2 0",
    ],
    "cc-by-nc": [
        "<<licensed|released|available|distributed|shared>> under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by nc <<optional>><<var:2>><</optional>>",
        "creative commons attribution noncommercial <<optional>><<var:2>><</optional>> <<optional>>international<</optional>> <<license|licence>>",
    ],
    "cc-by": ["<<licensed|released|available|distributed|shared>> under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by <<4|3|2>> 0"],
    "cc-by-sa": ["cc by sa <<optional>><<4|3|2>> 0<</optional>>", "creative commons attribution sharealike"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "<<licensed|released|available|distributed>> under the <<optional>><<2|3>> clause<</optional>> bsd <<optional>><<2|3>> clause<</optional>> license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this <<var:3>> for any purpose with or without fee is hereby granted",
        "<<licensed|released|available|distributed>> under the isc license",
    ],
    "gpl": [
        "gnu <<lesser|affero>> general public license",
        "gnu general public license <<optional>>version <<2|3>><</optional>>",
        "<<licensed|released|available|distributed>> under the <<optional>>gnu<</optional>> <<gpl|lgpl|agpl>>",
    ],
    "mpl-2": ["mozilla public license <<optional>>v<</optional>> <<optional>>version<</optional>> 2 0"],
    "unlicense": ["this is free and unencumbered <<var:1>> released into the public domain"],
}

#: Everything in ASCII but letters and digits parts words; upper case is lowered.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


@dataclass
class State:
    """One state of an automaton: words that lead on, a step on any word, and free steps."""

    on: dict[bytes, list[int]] = field(default_factory=dict)
    any_word: list[int] = field(default_factory=list)
    free: list[int] = field(default_factory=list)


class Automaton:
    """Token automaton of one template; ``longest`` gives the end of its longest match from a word on."""

    def __init__(self, template: str):
        self.states: list[State] = [State()]
        self.final = self._build(re.findall(r"<</?[^<>]+>>|[^\s<>]+", template.lower()), 0)
        self.starts = {w for s in self._closed({0}) for w in self.states[s].on}
        if any(self.states[s].any_word or s == self.final for s in self._closed({0})):
            raise ValueError("a template must start with a mandatory word or an optional one before it")

    def _new(self) -> int:
        self.states.append(State())
        return len(self.states) - 1

    def _build(self, tokens: list[str], at: int) -> int:
        opened: list[int] = []
        for token in tokens:
            if token == "<<optional>>":
                opened.append(at)
            elif token == "<</optional>>":
                end = self._new()
                self.states[at].free.append(end)
                self.states[opened.pop()].free.append(end)
                at = end
            elif token.startswith("<<var:"):
                end = self._new()
                self.states[at].free.append(end)
                for _ in range(int(token[6:-2])):
                    step = self._new()
                    self.states[at].any_word.append(step)
                    self.states[step].free.append(end)
                    at = step
                at = end
            else:
                end = self._new()
                for word in token.strip("<>").split("|"):
                    self.states[at].on.setdefault(word.encode(), []).append(end)
                at = end
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.states[todo.pop()].free:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest match that starts at ``start``, or -1."""
        now, end = self._closed({0}), -1
        for i in range(start, len(words)):
            step = set()
            for s in now:
                state = self.states[s]
                step.update(state.any_word)
                step.update(state.on.get(words[i], ()))
            if not step:
                break
            now = self._closed(step)
            if self.final in now:
                end = i + 1
        return end


class Matcher:
    """All automata, entered only at words that one of them starts with."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.entries: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, forms in templates.items():
            for automaton in map(Automaton, forms):
                for word in automaton.starts:
                    self.entries.setdefault(word, []).append((label, automaton))
        self.watched = frozenset(self.entries) | {p[0] for p, _ in self.phrases}

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score) of one text."""
        words = text.translate(FOLD).split()
        places, base, found, covered = [], set(), set(), 0
        if not self.watched.isdisjoint(words):
            hits = [i for i, w in enumerate(words) if w in self.watched]
            for i in hits:
                for phrase, label in self.phrases:
                    if words[i : i + len(phrase)] == phrase:
                        places.append(i)
                        base.add(label)
                        covered = max(covered, len(phrase))
                for label, automaton in self.entries.get(words[i], ()):
                    end = automaton.longest(words, i)
                    if end >= 0:
                        found.add(label)
                        covered = max(covered, end - i)
        labels = base | found
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            1.0 - 1.0 / (1.0 + covered) if labels else 0.0,
        )


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licenses of each row of (doc_id, text).

    Words are runs of lower-case ASCII letters, digits and all other Unicode characters. ``n_base`` counts
    the places of the base phrases, ``first_word`` and ``last_word`` are the outer ones (null without any),
    ``labels`` adds the templates that match somewhere word by word, and the score grows with the words of
    the longest match: 1 - 1 / (1 + words), 0 without a label. Null and empty texts have no words and empty
    labels; repeated rows, null ids and very long texts are rows like others. No row is moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, phrases)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in text_batches(batches):
            rows = [matcher.scan(t) for t in byte_texts(batch)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
