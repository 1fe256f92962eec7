"""Token ids of whole texts by the tokenizers library, with words encoded once.

A text is cut before each space that follows a character other than white space. No token of the two kinds of public
vocabulary here crosses such a place, so the ids of the pieces, one after another, are the ids of the text. Pieces are
looked up in a bounded store of encoded ones; new pieces are encoded many at a time, and where the vocabulary's own rule
always cuts between letters, digits, marks and white space, by these parts. A text where a space follows other
white space, or that may name one of the vocabulary's special tokens, goes through the library whole, as it is loaded: the
name of a special token inside a text is that token.
"""

from __future__ import annotations

import functools
import re

import numpy as np

#: Pieces kept in a worker: two generations of so many, about 200 bytes each. Characters that are looked at together.
STORE, CHARS = 600_000, 3_000_000
#: Runs of letters with nothing to normalise but their case, digits, and runs of marks: what words are cut to. An apostrophe
#: makes other pieces, and < may begin a special token.
PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
#: Words that are such pieces and white space.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~\n\t]+")


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """encode(texts): for each text its ids as little-endian bytes of `dtype`, without the end id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.t = tokenizer(path)
        vocab = self.t.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.word_ends = any(x.endswith("</w>") for x in vocab)
        # Tokens at which a piece is told from the next one: its first token has the space, or its last one a word's end.
        self.mark = np.zeros(self.size, bool)
        for x, i in vocab.items():
            self.mark[i] = x.endswith("</w>") if self.word_ends else x.startswith("Ġ")
        # Whether pieces are cut as PART cuts them, white space being none.
        probe = [x for x, _ in self.t.pre_tokenizer.pre_tokenize_str("ab$#12\nc.")]
        self.cuts = self.word_ends and probe == ["ab", "$#", "1", "2", "c", "."]
        # Parts have nothing left to normalise.
        self.plain = self.t
        if self.cuts:
            self.plain = tokenizer(path)
            self.plain.normalizer = None
        # How the names of special tokens begin.
        self.special = sorted({x.content[:2] for x in self.t.get_added_tokens_decoder().values() if x.special})
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> dict[str, bytes | None]:
        """Ids of ` word` for each word; None where the next space doesn't begin a piece."""
        out: dict[str, bytes | None] = {}
        joined, single, cut = [], [], {}
        for w in words:
            if not w or w[-1].isspace():
                out[w] = None
            elif not self.word_ends:
                joined.append(w)
            elif self.cuts and PLAIN.fullmatch(w):
                cut[w] = PART.findall(w.lower())
            else:
                single.append(w)
        if cut:
            # Parts are words themselves, many of which have been met before.
            young, old = self.young, self.old
            parts = {p: old.get(p) if (x := young.get(p)) is None else x for p in set().union(*cut.values())}
            joined = [p for p, x in parts.items() if x is None]
        for at in range(0, len(joined), 500):
            some = joined[at : at + 500]
            (e,) = self.plain.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            marks = np.flatnonzero(self.mark[ids])
            if len(marks) != len(some):
                single += some
                continue
            if self.word_ends:
                cuts = marks + 1
                starts = np.concatenate(([0], cuts[:-1]))
            else:
                starts, cuts = marks, np.append(marks[1:], len(ids))
            raw, b = ids.tobytes(), self.dtype.itemsize
            out.update(zip(some, (raw[s * b : c * b] for s, c in zip(starts.tolist(), cuts.tolist(), strict=True)), strict=True))
        for at in range(0, len(single), 4000):
            some = single[at : at + 4000]
            out.update(zip(some, self.ids([" " + w for w in some]), strict=True))
        if cut:
            parts.update((p, out[p]) for p in joined)
            out.update((w, parts[x[0]] if len(x) == 1 else b"".join(map(parts.__getitem__, x))) for w, x in cut.items())
        return out

    def known(self, words: set[str]) -> dict[str, bytes | None]:
        """Ids of these words; those of the last generations are not encoded again."""
        if len(self.young) > STORE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = words.difference(young)
        if old:
            back = {w: old[w] for w in missing if w in old}
            young.update(back)
            missing.difference_update(back)
        young.update(self.learn(list(missing)))
        return young

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > CHARS:
                out += self.encode_some(some)
                some, size = [], 0
        return out + self.encode_some(some) if some else out

    def encode_some(self, texts: list[str]) -> list[bytes]:
        # A text that goes whole has no pieces here.
        cut = [[t] if any(x in t for x in self.special) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for w in cut:
            seen.update(w[1:])
        known = self.known(seen)
        firsts = self.ids([w[0] for w in cut])
        out, whole = [], []
        for i, w in enumerate(cut):
            try:
                if len(w) > 1 and (not w[0] or w[0][-1].isspace()):
                    raise TypeError
                out.append(firsts[i] + b"".join(map(known.__getitem__, w[1:])))
            except TypeError:  # a piece that isn't one, unless it ends the text
                out.append(b"")
                whole.append(i)
        for i, x in zip(whole, self.ids([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each vocabulary in a Python worker."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
