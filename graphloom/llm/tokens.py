"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

A text is cut before each space that a letter, digit or ASCII sign follows. The tokenizer's own rule never joins what
stands on the two sides of such a place, so the ids of the pieces, one after another, are the ids of the
text. Nor does it join letters with the punctuation behind them, so a piece of letters and a tail is a word
and its tail; nor a line feed with what stands on either side. Many texts are encoded together: the library gets each
distinct word of theirs once, many in one call. Texts are cut, pieces looked up and ids joined as Arrow
arrays; only distinct pieces that aren't letters and a tail, and the first of each text, are Python objects.
A text that holds the string of an added token, such as <|endoftext|>, is given to the library whole: there
the token's own id stands for it.
"""

from __future__ import annotations

import functools
import gc
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that a letter, digit or ASCII sign follows; it belongs to the piece after it.
CUT = re.compile(r" (?=[!-~]|[^\W_])")
#: A space that none follows.
ODD = re.compile(r" (?![!-~]|[^\W_])")
#: Punctuation that may follow a word's letters: all of ASCII but the apostrophe, which may begin a contraction.
TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: A line feed between characters that aren't white space: a word of its own, which joins neither side.
LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: Characters below it are letters by any version of Unicode if they are by this one.
OLD_LETTERS = "ɐ"
#: A word of such letters alone, as Arrow's expressions write it.
OLD_WORD = r"\A[" + "".join(c for c in map(chr, range(ord(OLD_LETTERS))) if c.isalpha()) + r"]+\z"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def binary(data: np.ndarray | pa.Buffer | bytes, sizes: np.ndarray) -> pa.Array:
    """Strings of bytes that lie one behind another, by their sizes in bytes."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Encoder:
    #: Characters of the texts that are encoded together, about: they bound what a worker holds.
    TOGETHER = 12_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t["content"] for t in json.load(open(path))["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        letters = byte_letters()
        self.space, self.letters = letters[32], str.maketrans({chr(b): c for b, c in letters.items()})
        #: Whether an id's bytes begin with a space.
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for w, i in vocab.items() if w.startswith(self.space)]] = True
        # the same model for words that are cut and written in the vocabulary's letters already
        bare = json.dumps(json.load(open(path)) | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []})
        self.model, self.lines = Tokenizer.from_str(bare), Tokenizer.from_str(bare)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.space, "merged_with_next")
        self.lines.pre_tokenizer = pre_tokenizers.Split(letters[10], "isolated")
        self.feed = self.ids("\n")

    def special(self, text: str) -> bool:
        """Whether a text holds the string of an added token: the library takes it out before it cuts words."""
        return any(m in text for m in self.marks)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def each(self, words: pa.Array, plain: bool) -> pa.Array:
        """The ids of words without spaces, with a space put before each; plain: they are all old letters."""
        found, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            text = b" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes()
            if plain:
                ids = self.model.encode_batch_fast([text.decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids
            else:
                ids = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
            found.append(np.array(ids, "<u4"))
            starts = np.flatnonzero(self.spaced[found[-1]])
            assert len(starts) == len(some)
            sizes.append(np.diff(starts, append=len(ids)))
        return binary(np.concatenate(found), 4 * np.concatenate(sizes))

    def after(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of strings that neither begin nor end with white space, with a line feed put before each."""
        bare = [p.rstrip(TAIL) for p in parts]
        plain = [w.isalpha() and max(w) < OLD_LETTERS for w in bare]
        out = {p: self.ids("\n" + p) for p in compress(parts, map(not_, plain))}
        some, bare = list(compress(parts, plain)), list(compress(bare, plain))
        if some:
            behind = [p[len(w) :] for p, w in zip(some, bare, strict=True)]
            tails = {t: self.ids(t) for t in set(behind)}
            text = "\n" + "\n".join(bare)
            ids = np.array(self.lines.encode_batch_fast([text.encode().decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, "<u4")
            raw, starts = ids.tobytes(), (4 * np.flatnonzero(ids == np.frombuffer(self.feed, "<u4")[0])).tolist()
            for p, t, a, b in zip(some, behind, starts, [*starts[1:], len(raw)], strict=True):
                out[p] = raw[a:b] + tails[t]
        return out

    def simple(self, pieces: pa.Array, bare: pa.Array) -> pa.Array:
        """The ids of pieces that are old letters (bare) and a tail, with a space put before each."""
        words = bare.dictionary_encode()
        offsets, data = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset :][: len(pieces) + 1], np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets) - pc.binary_length(bare).to_numpy()
        place = np.repeat(offsets[1:] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        tails = binary(data[place], sizes).dictionary_encode()
        ids = pa.concat_arrays([self.each(words.dictionary, True), pa.array([self.ids(t.decode()) for t in tails.dictionary.to_pylist()], pa.large_binary())])
        both = ids.take(pa.array(np.column_stack([words.indices.to_numpy(), len(words.dictionary) + tails.indices.to_numpy()]).ravel()))
        return binary(both.buffers()[2] or b"", np.diff(np.frombuffer(both.buffers()[1], np.int64)[: len(both) + 1 : 2]))

    def learn(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece, with a space put before it."""
        n, at = len(pieces), np.flatnonzero(pc.match_substring(pieces, "\n"))
        lines = {k: parts for k, p in zip(at.tolist(), pieces.take(pa.array(at)).to_pylist(), strict=True) if len(parts := LINE.split(p)) > 1}
        pieces = pa.concat_arrays([pieces, pa.array([parts[0] for parts in lines.values()], pa.large_string())])
        bare = pc.ascii_rtrim(pieces, TAIL)
        kind = np.where(pc.match_substring_regex(bare, OLD_WORD), 0, np.where(pc.match_substring(pieces, " "), 2, 1))
        kind[list(lines)] = 3
        some = pa.array(kind == 0)
        whole = [pc.filter(pieces, pa.array(kind == k)).to_pylist() for k in range(1, 3)]
        out = [self.simple(pc.filter(pieces, some), pc.filter(bare, some)), self.each(pa.array(whole[0], pa.large_string()), False), pa.array([self.ids(" " + p) for p in whole[1]], pa.large_binary())]
        order = np.empty(len(pieces), np.int64)
        order[np.argsort(kind, kind="stable")] = np.arange(len(pieces))
        if lines:
            heads = pa.concat_arrays(out).take(pa.array(order[n:])).to_pylist()
            after = self.after(list({x for parts in lines.values() for x in parts[1:]}))
            out.append(pa.array([b"".join([head, *map(after.__getitem__, parts[1:])]) for head, parts in zip(heads, lines.values(), strict=True)], pa.large_binary()))
        return pa.concat_arrays(out).take(pa.array(order[:n]))

    def together(self, texts: list[str | None]) -> list[bytes]:
        whole = {k: self.ids(t) for k, t in enumerate(texts) if t and self.special(t)}
        odd = [k for k, t in enumerate(texts) if t and k not in whole and ODD.search(t)]
        left = {*whole, *odd}
        even = [k for k in range(len(texts)) if k not in left]
        kind = pa.list_(pa.large_string())
        cut = pa.concat_arrays([pc.split_pattern(pa.array([texts[k] or "" for k in even], pa.large_string()), " ").cast(kind), pa.array([CUT.split(texts[k]) for k in odd], kind)])
        bounds, flat = cut.offsets.to_numpy(), cut.values
        first = bounds[:-1]
        heads = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(flat.take(pa.array(first)).to_pylist(), add_special_tokens=False)]
        known = flat.dictionary_encode()
        at, pieces = known.indices.to_numpy(), known.dictionary
        del cut, flat, known
        # a text's first piece has no space before it
        used = np.bincount(at, minlength=len(pieces)) > np.bincount(at[first], minlength=len(pieces))
        found = pa.concat_arrays([self.learn(pc.filter(pieces, pa.array(used))), pa.array(heads, pa.large_binary())])
        at = (np.cumsum(used) - 1)[at]
        at[first] = used.sum() + np.arange(len(first))
        ids = found.take(pa.array(at))
        data, ends = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int64)[bounds].tolist()
        out = whole | {k: bytes(data[a:b]) for k, a, b in zip(chain(even, odd), ends, ends[1:], strict=False)}
        return [out[k] for k in range(len(texts))]

    def stream(self, rows: Iterable[tuple[object, str | None]]) -> Iterator[tuple[object, bytes]]:
        """For (key, text), the key and the text's ids as little-endian unsigned 32-bit integers; none for null."""
        keys, texts, n = [], [], 0

        def done() -> list[tuple[object, bytes]]:
            on = gc.isenabled()
            gc.disable()  # it makes many strings and no cycles
            try:
                return list(zip(keys, self.together(texts), strict=True))
            finally:
                if on:
                    gc.enable()

        for key, text in rows:
            keys.append(key)
            texts.append(text)
            n += len(text or "")
            if n >= self.TOGETHER:
                yield from done()
                keys, texts, n = [], [], 0
        if keys:
            yield from done()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for _, ids in self.stream((None, t) for t in texts):
            yield ids


@functools.cache
def encoder(path: str) -> Encoder:
    """One in each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
