"""Encoding through an installed tokenizer, each of the pieces that can stand alone only once.

``word_ids`` (and ``text_ids``) encodes the distinct words of a batch and keeps nothing
between batches; ``span_counts`` remembers the counts of pieces. Both give exactly what the tokenizer gives for the whole text. They cut
it only where the tokenizer's own splitting must cut, whatever stands around:

* ``word_ids``: for tokenizers that lower, compose (NFC) and drop white space.
  Nothing composes with ASCII white space and no token spans it.
* ``span_counts``: for byte-level tokenizers whose pattern never lets white space
  follow anything else within a match, so a text can be cut in front of any
  ASCII white space that follows a character that is not white space.

A text that holds one of the tokenizer's special strings is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What some edition of Unicode or some library takes for white space, beyond ASCII's; as part of a character class.
ODD_SPACES = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
ANY_ODD_SPACE = re.compile(f"[{ODD_SPACES}]")
SPAN = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: A worker remembers the counts of so many pieces, then starts anew.
REMEMBERED = 400_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> re.Pattern:
    found = [re.escape(t.content) for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(found) or r"(?!)")


#: Letters that belong to \p{L} in every edition, have no marks to compose with, and whose lower case is one letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word of them, with ASCII punctuation behind it: two places where any of the patterns must cut.
PLAIN = re.compile(rf"( ?[{LETTERS}]+)([!-/:-@\[-`{{-~]*)")
#: The same for words without white space, by Arrow's matcher.
PLAIN_WORD = rf"^(?P<word>[{LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"
#: Plain words encoded at once; other pieces, which can be long; words whose ids are put together at once.
AT_ONCE, OTHER_AT_ONCE, GATHERED = 20_000, 1_000, 1 << 18


def encode(path: str, pieces: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)]


def encode_plain(path: str, words: list[str], edge: np.ndarray, ends: bool) -> tuple[np.ndarray, list[int]]:
    """The ids of plain words encoded as one text, and their bounds in them.

    ``edge`` tells of ids whether a plain word ends (``ends``) or begins there.
    """
    ids = np.array(encode(path, [(" " if ends else "").join(words)])[0], dtype="<u4")
    bounds = np.flatnonzero(edge[ids])
    bounds = [0, *(bounds + 1).tolist()] if ends else [*bounds.tolist(), len(ids)]
    if len(bounds) != len(words) + 1 or bounds[0] != 0 or bounds[-1] != len(ids):
        raise ValueError("words and their tokens don't correspond")
    return ids, bounds


class Remembered(dict):
    """piece -> the number of its tokens, for byte-level vocabularies; forgets all when full."""

    def __init__(self, path: str, edge: np.ndarray):
        self.path, self.edge = path, edge
        self.plain: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return encode(self.path, pieces)

    def learn_plain(self, words: list[str]) -> None:
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            _, bounds = encode_plain(self.path, some, self.edge, ends=False)
            self.plain.update(zip(some, (b - a for a, b in zip(bounds, bounds[1:]))))

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces - self.keys())
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(pieces)
        if len(self.plain) + len(new) > REMEMBERED:
            self.plain.clear()
        matches, other = [], []
        for piece in new:
            m = PLAIN.fullmatch(piece)
            if m and m[1][0] == " ":
                matches.append((piece, m[1], m[2]))
            else:
                other.append(piece)
        self.learn_plain(list({word for _, word, _ in matches if word not in self.plain}))
        tails = [t for t in {tail for _, _, tail in matches} if t and t not in self.plain]
        self.plain.update(zip(tails, map(len, self.encode(tails))))
        for piece, word, tail in matches:
            self[piece] = self.plain[word] + self.plain[tail] if tail else self.plain[word]
        self.update(zip(other, map(len, self.encode(other))))


def edges(path: str, test) -> np.ndarray:
    """For each id whether its token passes the test."""
    vocabulary = tokenizer(path).get_vocab()
    found = np.zeros(max(vocabulary.values()) + 1, bool)
    found[[i for token, i in vocabulary.items() if test(token)]] = True
    return found


@lru_cache(maxsize=4)
def word_ends(path: str) -> np.ndarray:
    return edges(path, lambda t: t.endswith("</w>"))


@lru_cache(maxsize=4)
def remembered_counts(path: str) -> Remembered:
    # In byte-level vocabularies this letter stands for the space.
    return Remembered(path, edges(path, lambda t: t.startswith("Ġ")))


def by_piece(known: Remembered, texts: list[str], split) -> list:
    """For each text, the sum of its pieces' counts. ``split`` gives None for a text to be encoded whole."""
    path, out = known.path, [None] * len(texts)
    group, size = [], 0

    def flush():
        nonlocal group, size
        known.learn(set().union(*(pieces for _, pieces in group)))
        for i, pieces in group:
            out[i] = sum(map(known.__getitem__, pieces))
        group, size = [], 0

    for i, text in enumerate(texts):
        pieces = None if specials(path).search(text) else split(text)
        if pieces is None:
            out[i] = len(known.encode([text])[0])
            continue
        group.append((i, pieces))
        size += len(pieces)
        if size > REMEMBERED // 8:
            flush()
    flush()
    return out


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ids, one after the other."""
    ends = np.cumsum(sizes)
    place = np.repeat(starts - ends + sizes, sizes)
    place += np.arange(len(place))
    return ids[place]


def key_ids(path: str, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and for each key where its ids start in them and how many there are."""
    plain = pc.match_substring_regex(keys, rf"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    n, sizes, ids = int(plain.sum()), np.zeros(len(keys), np.int64), [np.zeros(0, "<u4")]
    for at in range(0, n, AT_ONCE):
        some = order[at : min(at + AT_ONCE, n)]
        found, bounds = encode_plain(path, keys.take(pa.array(some)).to_pylist(), word_ends(path), ends=True)
        ids.append(found)
        sizes[some] = np.diff(bounds)
    for at in range(n, len(keys), OTHER_AT_ONCE):
        some = order[at : at + OTHER_AT_ONCE]
        found = encode(path, keys.take(pa.array(some)).to_pylist())
        ids += [np.array(f, "<u4") for f in found]
        sizes[some] = [len(f) for f in found]
    starts = np.empty(len(keys), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    return np.concatenate(ids), starts, sizes


def text_ids(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text.

    Arrow splits the texts, numbers their distinct words, and cuts those into the
    word in lower case and the punctuation behind it; only the distinct ones of
    these are encoded. The ids of the texts are put together by number, some texts at a time.
    """
    odd = specials(path)
    whole = {i for i, text in enumerate(texts) if odd.search(text.as_py())}
    split = texts
    if whole:  # texts that hold a special string are encoded as they are, the others without them
        split = pc.if_else(pa.array([i in whole for i in range(len(texts))], pa.bool_()), "", texts)
    words = pc.ascii_split_whitespace(split)
    numbered = words.flatten().dictionary_encode()
    distinct, number = numbered.dictionary, numbered.indices.to_numpy()
    found = pc.extract_regex(distinct, PLAIN_WORD)
    head = pc.if_else(found.is_valid(), pc.utf8_lower(found.field("word")), distinct)
    tail = pc.if_else(found.is_valid(), found.field("tail"), "")
    keys = pa.concat_arrays([head, tail]).dictionary_encode()
    ids, starts, sizes = key_ids(path, keys.dictionary)
    both = keys.indices.to_numpy().reshape(2, -1)  # of each distinct word, head and tail
    ids = gathered(ids, starts[both.T.ravel()], sizes[both.T.ravel()])
    sizes = sizes[both].sum(axis=0)
    starts = np.cumsum(sizes) - sizes
    bounds, at = words.offsets.to_numpy() - words.offsets[0].as_py(), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GATHERED, "right")) - 1)
        some = number[bounds[at] : bounds[stop]]
        ends = np.concatenate([[0], np.cumsum(sizes[some])])[bounds[at + 1 : stop] - bounds[at]]
        for i, part in enumerate(np.split(gathered(ids, starts[some], sizes[some]), ends), at):
            yield np.array(encode(path, [texts[i].as_py()])[0], "<u4") if i in whole else part
        at = stop


def word_ids(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    return [ids.tobytes() for ids in text_ids(path, pa.array(texts, pa.string()))]


def spans(text: str) -> list[str] | None:
    return None if ANY_ODD_SPACE.search(text) else SPAN.findall(text)


def span_counts(path: str, texts: list[str]) -> list[int]:
    """The number of tokens of each text."""
    return by_piece(remembered_counts(path), texts, spans)
