"""Byte-level BPE of whole texts inside tasks, as packed ids."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np

#: White space, a space, then white space or the end: only there does a cut before a space change the tokens.
IRREGULAR = re.compile(r"\s (?:\s|\Z)")
#: Letters (tested again), then punctuation of ASCII but for the apostrophe, which may start a piece of its own.
SIMPLE = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)\Z")
#: The letter that stands for each byte in a byte-level model: printable ones for themselves, the others from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = "".join(chr(b if b in PRINTABLE else 256 + sum(c not in PRINTABLE for c in range(b))) for b in range(256))
SPACE = BYTE_LETTERS[32]
NEWLINE_ID = "\n"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a byte-level BPE file of the tokenizers library.

    The byte-level splitter never joins a character that is not white space to a space after it, so a text may be cut
    before such a space and the parts encoded alone; ids of frequent words are kept. Texts with irregular runs of white space are
    encoded whole. ``cache_words`` bounds the memory of the table, not the result: once a table is full it becomes the
    older one, whose words move to the next table when they are met again, and the rest of it goes.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.line_feed = self._ids([NEWLINE_ID])[0]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = cache_words

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, text: str, space: str = "") -> bytes:
        """Ids of one piece of the splitter, by the file's model, where each byte is a letter; ``space`` is the one before it."""
        if not text.isascii():
            text = charmap_decode(text.encode(), "strict", BYTE_LETTERS)[0]
        return array("I", [t.id for t in self.model.tokenize(space + text)]).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word with a space before it.

        The splitter makes one piece of a run of letters, with the space before it, and one of the punctuation after it. Words of that form, and
        such words joined by single line feeds, go to the model by their pieces, which is what costs least; all others are encoded whole.
        """
        out: dict[str, bytes] = {}
        spaced, bare, rest, known, match = {}, {}, [], self.words.get, SIMPLE.match

        def simple(word: str, spaced: dict[str, bytes], space: str) -> bytes | None:
            found = match(word)
            if not found or not found[1].isalpha():
                return None
            letters, marks = found.groups()
            ids = spaced.get(letters) or (known(letters) if space else None)
            if ids is None:
                ids = spaced[letters] = self._piece(letters, space)
            if marks:
                if marks not in bare:
                    bare[marks] = self._piece(marks)
                ids += bare[marks]
            return ids

        for w in words:
            ids = simple(w, spaced, SPACE)
            if ids is None and "\n" in w:
                first, *others = w.split("\n")
                parts = [simple(first, spaced, SPACE), *[simple(x, bare, "") for x in others]]
                ids = None if None in parts else self.line_feed.join(parts)
            if ids is None:
                rest.append(w)
            else:
                out[w] = ids
        out.update(zip(rest, self._ids([" " + w for w in rest]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known, kept, plans, unknown, whole = self.words.get, self.older.get, [], {}, []
        for t in texts:
            if IRREGULAR.search(t):
                whole.append(t)
                plans.append(None)
                continue
            head, *words = t.split(" ")
            parts: list = list(map(known, words))
            gaps = [i for i, p in enumerate(parts) if p is None]
            for i in gaps:
                parts[i] = ids = kept(words[i])
                (unknown if ids is None else self.words)[words[i]] = ids
            gaps = [i for i in gaps if parts[i] is None]
            whole.append(head)
            plans.append((parts, gaps, words))
        new = self._learn(list(unknown))
        out = []
        for plan, head in zip(plans, self._ids(whole), strict=True):
            if plan is None:
                out.append(head)
                continue
            parts, gaps, words = plan
            for i in gaps:
                parts[i] = new[words[i]]
            out.append(head + b"".join(parts))
        self.words.update((w, ids) for w, ids in new.items() if len(w) <= 40)
        if len(self.words) > self.room:
            self.words, self.older = {}, self.words
        return out


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def encoded_rows(batches, path: str, end_id: int) -> Iterator[tuple[object, bytes]]:
    """(id, packed ids with the end id) of every row of Arrow batches with columns id and text; null text is empty."""
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for i, raw in zip(ids, enc.encode([t or "" for t in texts]), strict=True):
                yield i, raw + end
