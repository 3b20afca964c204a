"""Word-cached tokenization with a public tokenizer file.

The tokenizer splits at white space before anything else, so a text's ids are
the ids of its space-separated words in a row. Words repeat, so each worker
keeps a bounded table of words by 128-bit hash; new words are encoded in bulk by
the tokenizers library. A word that is Latin letters and then ASCII signs is
looked up in two parts: its splitting rule parts letters from signs, and none of
its normaliser's rules joins them. All other words are encoded whole. The Latin
letters need none of the normaliser and go straight to the byte-level model.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from focusloom.llm.common import word_hashes

END_ID = 2
#: Bytes of text encoded at once; longer texts go alone.
CHUNK_BYTES = 16 << 20
DEFAULT_TOKENIZER = "word_bpe_49k.json"
HASH = np.dtype([("a", np.uint64), ("b", np.uint64)])
#: Words kept by each Python worker (some 100 bytes each); when they are more, it begins anew.
CACHE_WORDS = 450_000
#: Trailing signs that the tokenizer parts from a word's letters, if nothing but letters of _LATIN stands before them.
_SIGNS = ".,!?;:*#$%&\"'()[]{}-_/\\=+~`@^"
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_encoders: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable sign by which byte-level models write each byte: itself if printable, else one from U+0100 on. Spaces stay."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)} | {32: " "}


def _string_hashes(words: pa.StringArray, cut: np.ndarray | None = None) -> np.ndarray:
    """Hashes (two each) of the strings, or of what follows their first cut bytes."""
    _, off, data = words.buffers()
    offsets = np.frombuffer(off, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    starts = offsets[:-1] if cut is None else offsets[:-1] + cut
    out = np.empty(len(words), HASH)
    out["a"], out["b"] = word_hashes(raw, starts, offsets[1:]), word_hashes(raw, starts, offsets[1:], 1)
    return out


class _Table:
    """Hash -> place in the pool of ids. Sorted by the first half of the hash; the second half confirms."""

    def __init__(self):
        self.keys, self.checks, self.first, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, positions of the hashes that aren't there)."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        slots = np.minimum(np.searchsorted(self.keys, hashes["a"]), len(self.keys) - 1)
        same = self.keys[slots] == hashes["a"]
        other = np.flatnonzero(same & (self.checks[slots] != hashes["b"]))
        for i in other.tolist():  # first halves that meet by chance stand side by side
            k = int(slots[i])
            while k < len(self.keys) and self.keys[k] == hashes["a"][i] and self.checks[k] != hashes["b"][i]:
                k += 1
            same[i] = k < len(self.keys) and self.keys[k] == hashes["a"][i]
            slots[i] = min(k, len(self.keys) - 1)
        return slots, np.flatnonzero(~same)

    def add(self, hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        keys = np.concatenate([self.keys, hashes["a"]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.checks = keys[order], np.concatenate([self.checks, hashes["b"]])[order]
        self.first, self.sizes = np.concatenate([self.first, first])[order], np.concatenate([self.sizes, sizes])[order]


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.light = Tokenizer(self.full.model)
        self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.mark = "7"
        self.mark_id = self.full.encode(self.mark, add_special_tokens=False).ids
        # the short cut holds for a file that lower-cases and has word ends; for others all words take the whole way
        probe = ["gar\u00e7ons", "ni\u00f1o", "words", "x", "\u00fcber"]
        want = [self._one(w) for w in probe]
        self.short_cut = len(self.mark_id) == 1 and self._bulk(self.light, probe) == want == [self._one(w.upper()) for w in probe]
        self.cache_words = cache_words
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = _Table(), _Table()
        self.pool = np.zeros(0, np.uint32)

    def _one(self, word: str) -> bytes:
        return np.array(self.full.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _bulk(self, tokenizer, words: list[str]) -> list[bytes]:
        """Encodes words many at a time, parted by a digit that none of them holds."""
        out: list[bytes] = []
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            text = f" {self.mark} ".join(part)
            if tokenizer is self.light and not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id[0]) if len(self.mark_id) == 1 else np.zeros(0, int)
            if len(cuts) != len(part) - 1:
                out += map(self._one, part)
                continue
            raw = ids.tobytes()
            out += [raw[4 * b : 4 * e] for b, e in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]
        return out

    def _store(self, table: _Table, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        table.add(hashes, np.cumsum(sizes) - sizes + len(self.pool), sizes)
        self.pool = np.concatenate([self.pool, ids])

    def _piece_slots(self, hashes: np.ndarray, strings) -> np.ndarray:
        """strings(positions) gives the strings there and whether they are plain lower-case Latin words."""
        slots, new = self.pieces.find(hashes)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            words, plain = strings(new[at])
            blobs: list[bytes] = [b""] * len(words)
            for tokenizer, mine in ((self.light, [i for i, p in enumerate(plain) if p]), (self.full, [i for i, p in enumerate(plain) if not p and self.mark not in words[i]])):
                for i, blob in zip(mine, self._bulk(tokenizer, [words[i] for i in mine])):
                    blobs[i] = blob
            for i, p in enumerate(plain):
                if not p and self.mark in words[i]:
                    blobs[i] = self._one(words[i])
            self._store(self.pieces, fresh, np.frombuffer(b"".join(blobs), np.uint32), np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2)
            slots, _ = self.pieces.find(hashes)
        return slots

    def _add(self, hashes: np.ndarray, words: pa.StringArray) -> None:
        """New words of Latin letters and trailing signs are looked up in two parts; of others the second part is empty."""
        core = pc.utf8_rtrim(words, characters=_SIGNS)
        latin = pc.match_substring_regex(core, _LATIN)
        core = pc.if_else(latin, pc.utf8_lower(core), words)
        plain = latin.to_numpy(zero_copy_only=False) & self.short_cut
        length = pc.binary_length(core).to_numpy().astype(np.int64)
        a = self._piece_slots(_string_hashes(core), lambda at: (core.take(pa.array(at)).to_pylist(), plain[at]))

        def signs(at):
            got = [w.encode()[n:].decode() for w, n in zip(words.take(pa.array(at)).to_pylist(), length[at])]
            return got, np.zeros(len(got), bool)

        b = self._piece_slots(_string_hashes(words, length), signs)
        a, _ = self.pieces.find(_string_hashes(core))  # the table may have grown meanwhile
        p = self.pieces
        first = np.stack([p.first[a], p.first[b]], 1).ravel()
        sizes = np.stack([p.sizes[a], p.sizes[b]], 1).ravel()
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self._store(self.words, hashes, ids, sizes.reshape(-1, 2).sum(1))

    def _slots(self, words: pa.StringArray) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int64)
        if len(self.words.keys) > self.cache_words:
            self.clear()
        hashes = _string_hashes(words)
        slots, new = self.words.find(hashes)
        if len(new):
            self._add(hashes[new], words.take(pa.array(new)))
            slots, _ = self.words.find(hashes)
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, uint32; offsets). Nulls are empty; each text ends with END_ID."""
        if texts.null_count:
            texts = texts.fill_null("")
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        bounds = bounds - bounds[0]
        codes = words.indices.to_numpy()
        slots = self._slots(words.dictionary)
        lengths = self.words.sizes[slots][codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        offsets = np.concatenate([[0], np.cumsum(ends[bounds[1:]] - ends[bounds[:-1]] + 1)])
        out = np.full(offsets[-1], END_ID, np.uint32)
        if ends[-1]:
            gather = np.repeat(self.words.first[slots][codes] - ends[:-1], lengths)
            gather += np.arange(ends[-1])
            keep = np.ones(offsets[-1], bool)
            keep[offsets[1:] - 1] = False
            out[keep] = self.pool[gather]
        return out, offsets


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded_rows(batch: pa.RecordBatch, text: str, path: str):
    """(first row, end row, ids, offsets) of runs of rows of about CHUNK_BYTES of text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        base = sizes[at - 1] if at else 0
        end = min(n, max(at + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES, "right"))))
        ids, offsets = encoder(path).encode(column.slice(at, end - at))
        yield at, end, ids, offsets
        at = end
