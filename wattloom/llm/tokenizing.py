"""Fast, exact token ids from the public tokenizer files, for use inside tasks.

Both tokenizers split a text into words before anything else, and no rule of theirs looks across
a space or line break that stands between two other characters, nor joins a letter or digit with
the comma or full stop that ends its word. So a text in which no two white-space characters meet
is cut at those places, and each piece (with the space before it, where the tokenizer keeps that)
is encoded once per worker, gets a number, and its ids are then gathered by that number from a pool of bounded size. New pieces of many texts (GROUP
characters, or one longer text) are encoded together, and a piece is looked up once for all of them. Any other text, and any that may hold a
special token's string, is encoded as a whole. The ids are the same either way.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of LONGEST characters at most that a worker remembers, and ids of all; beyond, those used less than OFTEN times are forgotten.
REMEMBER, LONGEST, POOL, OFTEN = 150_000, 64, 2_000_000, 2
#: Characters of texts whose new pieces are encoded together.
GROUP = 1 << 20
#: White space other than space and line break, and what stands between pieces here.
_ODD = "\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_AFTER_SIGN = re.compile(r"[.,](?<![^\W_][.,])(?=\s|\Z)")


def _as_a_whole(text: str) -> bool:
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or "<|" in text:
        return True
    return any(c in text for c in (_ODD if text.isascii() else _ODD + _ODD_WIDE)) or bool(_AFTER_SIGN.search(text))


class _Memory:
    """Pieces by number, and their ids in one array: where each one's begin, how many there are, and how often it was used."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.pool, self.held, self.n = np.zeros(1 << 16, np.int32), 0, 0
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def numbers(self, pieces: list[str], times: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """The numbers of different pieces, and those that are new, in the order of theirs; times: how often each is used."""
        found = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        more = max(0, int(found.max(initial=-1)) + 1 - self.n)
        new = list(islice(reversed(self.number), more))[::-1]
        self.first, self.n = self.n, self.n + more
        self.starts, self.sizes, self.uses = (np.append(x, np.zeros(more, np.int64)) for x in (self.starts, self.sizes, self.uses))
        self.uses[found] += times
        return found, new

    def learn(self, places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of some of the new pieces (by place among these)."""
        if self.held + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32))
        self.pool[self.held : self.held + len(ids)] = ids
        at = self.first + places
        self.sizes[at], self.starts[at] = sizes, self.held + np.cumsum(sizes) - sizes
        self.held += len(ids)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)], sizes

    def forget(self, new: list[str]) -> None:
        for p in new:
            if len(p) > LONGEST:
                del self.number[p]
        if len(self.number) > REMEMBER or self.held > POOL:
            often = [p for p, k in self.number.items() if self.uses[k] >= OFTEN][: REMEMBER // 2]
            old = np.fromiter(map(self.number.__getitem__, often), np.int64, len(often))
            ids, sizes = self.ids(old)
            if len(ids) > POOL // 2:
                often, ids, sizes = [], ids[:0], sizes[:0]
            self.__init__()
            self.numbers(often, np.ones(len(often), np.int64))
            self.learn(np.arange(len(often)), sizes, ids)


@cache
def encoder(path: str, keeps_space: bool):
    """A function from texts to their id arrays (numpy int32), one after another."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    memory = _Memory()
    gap = "\0 " if keeps_space else "\0"

    edge = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that begin (keeps_space) or end a word of letters
    for token, i in tokenizer.get_vocab().items():
        edge[i] = token.startswith("\u0120") if keeps_space else token.endswith("</w>")

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def learn(pieces: list[str]) -> None:
        isword = (lambda p: p[1:].isalpha() and p[0] == " ") if keeps_space else str.isalpha
        mine = np.fromiter(map(isword, pieces), bool, len(pieces))
        words, others = np.flatnonzero(mine), np.flatnonzero(~mine).tolist()
        for at in range(0, len(words), 20_000):  # as one text, which is cheaper than one by one; every word has one edge
            some = words[at : at + 20_000]
            ids = ids_of(("" if keeps_space else " ").join([pieces[k] for k in some.tolist()]))
            edges = np.flatnonzero(edge[ids])
            if len(edges) == len(some):
                memory.learn(some, np.diff(np.append(edges, len(ids)) if keeps_space else np.append(0, edges + 1)), ids)
            else:
                others += some.tolist()
        if others:
            found = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False)]
            memory.learn(np.array(others), np.array([len(x) for x in found]), np.concatenate(found))

    def cut(text: str) -> str:
        """The text with NUL between its pieces."""
        text = text.replace(" ", gap).replace("\n", "\0\n\0" if keeps_space else "\0")
        return (text + "\0").replace(",\0", "\0,\0").replace(".\0", "\0.\0").rstrip("\0")

    def together(texts: list[str]) -> Iterator[np.ndarray]:
        pieces = [None if not t or _as_a_whole(t) else cut(t) for t in texts]
        own = pc.split_pattern(pa.array([p for p in pieces if p is not None], pa.large_string()), "\0")
        many, each = pc.list_value_length(own).to_numpy(), own.flatten().dictionary_encode()
        places = each.indices.to_numpy()
        numbers, new = memory.numbers(each.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(places, minlength=len(each.dictionary)))
        if new:
            learn(new)
        ids, sizes = memory.ids(numbers[places])
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(many))].tolist()
        at = 0
        for text, some in zip(texts, pieces, strict=True):
            if some is not None:
                yield ids[ends[at] : ends[at + 1]]
                at += 1
            else:
                yield ids_of(text) if text else np.zeros(0, np.int32)
        memory.forget(new)

    def encode(texts: Iterable[str]) -> Iterator[np.ndarray]:
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP:
                yield from together(group)
                group, held = [], 0
        if group:
            yield from together(group)

    return encode
