"""Token ids of whole texts by the tokenizers library, with each distinct piece of a slice encoded once.

The public byte-level BPE splits a text by a fixed pattern before it merges bytes. Where no two white-space characters meet, a space
begins a new piece with the word after it, and a line end is a piece of its own; so the text can be cut there, and the ids of the
parts joined are the ids of the whole. Words repeat, so only the distinct parts of a slice are encoded. Most are a word with marks behind
it: two pieces, which go to the tokenizer's model as they are. The others go to the tokenizer, one per line of a few long texts whose
ids are told apart by the line end's id. Texts in which white space meets (or that hold U+0000) are encoded as
they are.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from brindle.llm.base import slices, spread, texts_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text whose distinct parts are encoded together.
SLICE = 8 << 20
#: Parts whose ids a Python worker remembers from slice to slice and task to task; the first ones seen, which frequent words are among.
REMEMBERED = 300_000
#: What the pattern's \s takes.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
ODD_TEXT = rf"\x00|{WHITE}{WHITE}"
#: A part that can be one line of a longer text: no white space but one leading space.
LINE = r"^ ?[^\x09-\x0D\x1C-\x20\x85\p{Z}]+$"
#: A part of one word and marks behind it, which the pattern takes as two pieces. An apostrophe is no such mark: it may begin a piece with letters.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = rf"^ ?[{LETTERS}]+[{re.escape(MARKS)}]*$"


#: By tokenizer: parts, all their ids, start and length of each part's.
_known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = {}


@functools.cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _encode(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def _byte_names() -> dict[int, str]:
    """How a byte-level model writes each byte: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _merge(path: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has, of texts that the pattern leaves whole and that have no line end: the model merges them as they are."""
    named = "\n".join(pieces).encode().decode("latin-1").translate(_byte_names()).split(_byte_names()[10]) if pieces else []
    tokenize, ids, size = tokenizer(path).model.tokenize, [], []
    for x in named:
        found = tokenize(x)
        ids += [t.id for t in found]
        size.append(len(found))
    return np.array(ids, np.uint32), np.array(size, np.int64)


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each array has."""
    return np.concatenate([*arrays, np.zeros(0, np.uint32)]), np.array([len(x) for x in arrays], np.int64)


def _word_ids(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words with the marks behind them, and how many each has. Each word and each run of marks is encoded once."""
    bare, marks = (x.dictionary_encode() for x in (pc.utf8_rtrim(words, MARKS), pc.utf8_ltrim(words, " " + LETTERS)))
    word_ids, word_size = _merge(path, bare.dictionary.to_pylist())
    mark_ids, mark_size = _joined(_encode(path, marks.dictionary.to_pylist()))
    at = [x.indices.to_numpy(zero_copy_only=False) for x in (bare, marks)]
    start, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
    start[:, 0], size[:, 0] = (np.cumsum(word_size) - word_size)[at[0]], word_size[at[0]]
    start[:, 1], size[:, 1] = (len(word_ids) + np.cumsum(mark_size) - mark_size)[at[1]], mark_size[at[1]]
    return np.concatenate((word_ids, mark_ids))[spread(start.ravel(), size.ravel())], size.sum(axis=1)


def _part_ids(path: str, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct parts: all ids, start and length of each part's."""
    is_word = pc.match_substring_regex(parts, WORD).to_numpy(zero_copy_only=False)
    words, rest = np.flatnonzero(is_word), np.flatnonzero(~is_word)
    ids, own_size = _word_ids(path, parts.take(pa.array(words)))
    rest_ids, rest_start, rest_size = _other_ids(path, parts.take(pa.array(rest)))
    start, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    start[words], size[words] = np.cumsum(own_size) - own_size, own_size
    start[rest], size[rest] = len(ids) + rest_start, rest_size
    return np.concatenate((ids, rest_ids)), start, size


def _other_ids(path: str, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_part_ids() of any parts, by the tokenizer's own pattern."""
    (line_end,) = _encode(path, ["\n"])[0]
    as_line = pc.match_substring_regex(parts, LINE).to_numpy(zero_copy_only=False)
    lines, others = np.flatnonzero(as_line), np.flatnonzero(~as_line)
    names = parts.take(pa.array(lines)).to_pylist()
    texts = ["\n".join([*names[a : a + 8192], ""]) for a in range(0, len(names), 8192)]
    ids, _ = _joined(_encode(path, texts))
    ends = np.flatnonzero(ids == line_end)
    other_ids, other_size = _joined(_encode(path, parts.take(pa.array(others)).to_pylist()))
    start, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    start[lines] = np.concatenate(([0], ends[:-1] + 1))[: len(lines)]
    size[lines] = ends - start[lines]
    start[others] = len(ids) + np.cumsum(other_size) - other_size
    size[others] = other_size
    return np.concatenate((ids, other_ids)), start, size


def _remembered_ids(path: str, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_part_ids(), with only the parts encoded that aren't remembered."""
    if path not in _known:
        _known[path] = (parts.slice(0, 0), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    names, flat, start, size = _known[path]
    at = pc.fill_null(pc.index_in(parts, value_set=names), -1).to_numpy(zero_copy_only=False)
    fresh = np.flatnonzero(at < 0)
    new_names = parts.take(pa.array(fresh))
    new_flat, new_start, new_size = _part_ids(path, new_names)
    own_start, own_size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    old = at >= 0
    own_start[old], own_size[old] = start[at[old]], size[at[old]]
    own_start[fresh], own_size[fresh] = len(flat) + new_start, new_size
    if len(names) < REMEMBERED:
        add = slice(0, REMEMBERED - len(names))
        kept = new_flat[spread(new_start[add], new_size[add])]
        _known[path] = (pa.concat_arrays([names, new_names[add]]), np.concatenate((flat, kept)), np.concatenate((start, len(flat) + np.cumsum(new_size[add]) - new_size[add])), np.concatenate((size, new_size[add])))
    return np.concatenate((flat, new_flat)), own_start, own_size


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each text ended by END_ID, and the number of ids of each text with it."""
    odd = pc.match_substring_regex(texts, ODD_TEXT).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", "\x00 "), "\n", "\x00\n\x00")
    parts = pc.split_pattern(marked, "\x00")
    coded = parts.flatten().dictionary_encode()
    flat, start, size = _remembered_ids(path, coded.dictionary)
    code = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(size[code])))[parts.offsets.to_numpy()] if len(code) else np.zeros(1, np.int64)
    whole = _encode(path, texts.filter(pa.array(odd)).to_pylist())
    lengths = np.ones(len(texts), np.int64)
    lengths[plain] += np.diff(bounds)
    lengths[odd] += np.array([len(x) for x in whole], np.int64)
    out = np.full(int(lengths.sum()), END_ID, np.uint32)
    at = np.cumsum(lengths) - lengths
    out[spread(at[plain], np.diff(bounds))] = flat[spread(start[code], size[code])]
    for i, x in zip(np.flatnonzero(odd), whole, strict=True):
        out[at[i] : at[i] + len(x)] = x
    return out, lengths


def encoded(array: pa.Array, path: str):
    """token_ids() of slices of bounded size: (first row, ids, lengths)."""
    texts = texts_of(array)
    for a, b in slices(texts, SLICE):
        yield a, *token_ids(texts.slice(a, b - a), path)
