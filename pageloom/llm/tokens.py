"""Byte-level BPE ids of whole texts, each distinct piece of text encoded once.

The pre-tokenizer of a byte-level BPE always breaks before a blank that stands
between two visible characters, so a text split at its blanks gives the same ids
piece by piece.  Most pieces are words met before; a worker keeps their ids.
New pieces are put together again, many to a string, and handed to the tokenizer;
a token that starts with the blank starts the next piece.  A text with a blank in
any other place (doubled, at an end, beside a control character) or with the
string of a special token goes through the tokenizer as it is.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pageloom.llm.common import worker_cache

#: Visible characters on which no two readings of "white space" differ.
VISIBLE = re.compile("[^\\s\\u180e\\x00-\\x1f\\x7f-\\xa0]").match
#: Distinct pieces a worker keeps before it starts afresh, and those used at
#: least so often are kept over.
KEPT, KEPT_OVER = 500_000, 3
TOGETHER = 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizer of one file."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        size = self.tokenizer.get_vocab_size()
        self.vocabulary = size
        specials = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in specials]
        names = (self.tokenizer.id_to_token(i) or "x" for i in range(size))
        self.starts = np.fromiter((n[0] == "Ġ" for n in names), bool, size)
        self.place: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = itertools.chain.from_iterable(found)
        return np.fromiter(flat, np.uint32, int(counts.sum())), counts

    def _thin(self) -> None:
        """Forgets pieces that were seldom used."""
        keep = self.uses >= KEPT_OVER
        if keep.sum() > self.kept // 2:
            keep[:] = False
        sizes = np.diff(self.ends)
        self.flat = self.flat[np.repeat(keep, sizes)]
        self.ends = np.concatenate([[0], np.cumsum(sizes[keep])])
        names = itertools.compress(self.place, keep.tolist())
        self.place = {name: i for i, name in enumerate(names)}
        self.uses = np.zeros(len(self.place), np.int64)

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of pieces that were numbered but not encoded yet: a blank
        and visible ends, so they may stand one after another."""
        joined = ["".join(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
        run, _ = self._tokens(joined)
        heads = np.flatnonzero(self.starts[run])
        if len(heads) != len(new):
            raise ValueError("this tokenizer does not break before blanks")
        sizes = np.diff(np.append(heads, len(run)))
        self.flat = np.concatenate([self.flat, run])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all texts in one run, and how many each has."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.place) > self.kept:
            self._thin()
        column = pa.array(texts, pa.large_string())
        split = pc.split_pattern(column, " ")
        words = pc.dictionary_encode(split.flatten())
        code = words.indices.to_numpy()
        bounds = split.offsets.to_numpy()
        distinct = words.dictionary.to_pylist()
        head = np.zeros(len(code), bool)
        head[bounds[:-1]] = True
        place, known = self.place, len(self.place)
        at = np.fromiter(map(place.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        # texts with a blank in an unusual place, or a special token, go whole;
        # known pieces have visible ends
        good_start = at >= 0
        good_end = good_start.copy()
        new = np.flatnonzero(at < 0)
        words_new = [distinct[i] for i in new.tolist()]
        good_start[new] = [VISIBLE(w) is not None for w in words_new]
        good_end[new] = [VISIBLE(w[-1:]) is not None for w in words_new]
        tail = np.zeros(len(code), bool)
        tail[bounds[1:] - 1] = True
        bad = ~((good_start[code] | head) & (good_end[code] | tail))
        whole = np.logical_or.reduceat(bad, bounds[:-1])
        for s in self.special:
            whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        # the first piece has no blank before it, the last may end in anything
        alone = whole | (np.diff(bounds) == 1)
        inner = ~(head | tail) & ~np.repeat(alone, np.diff(bounds))
        code_inner = code[inner]
        used = np.zeros(len(distinct), bool)
        used[code_inner] = True
        for i in np.flatnonzero(used & (at < 0)).tolist():
            at[i] = place[distinct[i]] = len(place)
        if len(place) > known:
            self._learn([f" {w}" for w in itertools.islice(place, known, None)])
        codes = at[code_inner]
        self.uses += np.bincount(codes, minlength=len(self.uses))

        # heads, tails and texts that go whole are encoded here and now
        own, of = [], []
        first, last = bounds[:-1], bounds[1:] - 1
        for i, text in enumerate(texts):
            if alone[i]:
                own.append(text)
                of.append(first[i])
            else:
                own += [distinct[code[first[i]]], " " + distinct[code[last[i]]]]
                of += [first[i], last[i]]
        own_ids, own_counts = self._tokens(own)

        flat = np.concatenate([self.flat, own_ids])
        own_starts = len(self.flat) + np.cumsum(own_counts) - own_counts
        starts = np.zeros(len(code), np.int64)
        lengths = np.zeros(len(code), np.int64)
        starts[inner] = self.ends[codes]
        lengths[inner] = self.ends[codes + 1] - self.ends[codes]
        starts[of], lengths[of] = own_starts, own_counts
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        ids = flat[np.repeat(starts - before, lengths) + np.arange(total)]
        return ids, np.diff(np.append(before, total)[bounds])


def encoder(path: str, kept: int = KEPT) -> Encoder:
    return worker_cache(f"encoder:{kept}:{path}", lambda: Encoder(path, kept))
