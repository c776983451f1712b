"""Operator 10: BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a piece of the input go into a trie of byte symbols. Its nodes are visited depth
first; each node gets the last token of the encoding of its prefix (the one token that ends there
and stays apart from the last token before it), so a shared prefix is encoded once for all words
below it. A word's ids follow from the last tokens back to the root.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise
from string import punctuation

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of each of a worker's caches (words, chunks between blanks, pairs of tokens). A full one becomes the old generation, from
#: which entries in use move over; what stays in it is forgotten the next time (nothing but time is lost).
KEPT = 100_000
NEVER = 1 << 60
#: The splitting pattern for which letters with ASCII punctuation beside them needn't go through the pattern.
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of text whose distinct words share one trie.
PIECE = 2_000_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class _Endings:
    """Which tokens end at each place of a word: an automaton over the bytes of all tokens (Aho and Corasick 1975).

    ``inner[state]`` and ``final[state]`` are (length, token id) of the tokens that end there, the longest first, without and with
    the end-of-word suffix. Steps that aren't edges of the tokens' trie are found when they are first taken.
    """

    def __init__(self, tokens: list[tuple[bytes, int, bool]]):
        self.go: dict[int, int] = {}
        inner: list[tuple] = [()]
        final: list[tuple] = [()]
        nodes = [(0, 0, 0)]  # depth, parent, byte
        for body, token, ends in tokens:
            state = 0
            for depth, byte in enumerate(body, 1):
                step = state << 8 | byte
                if (after := self.go.get(step)) is None:
                    after = self.go[step] = len(inner)
                    inner.append(())
                    final.append(())
                    nodes.append((depth, state, byte))
                state = after
            (final if ends else inner)[state] = ((len(body), token),)
        self.inner, self.final, self.fail = inner, final, [0] * len(inner)
        for state in sorted(range(1, len(nodes)), key=nodes.__getitem__):  # by depth, so failures are known
            _, parent, byte = nodes[state]
            back = self.fail[state] = self.step(self.fail[parent], byte) if parent else 0
            inner[state] += inner[back]
            final[state] += final[back]

    def step(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        if (after := self.go.get(key)) is None:
            after = self.go[key] = self.step(self.fail[state], byte) if state else 0
        return after


class WordBpe:
    """Encoder and decoder of a word-level BPE file in the ``tokenizers`` JSON format.

    Covers what such a file states: NFC, white space and lower-case normalisation, one splitting
    pattern, byte symbols, an end-of-word suffix and added tokens.
    """

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = self.vocab
        #: Rank of the merge of two tokens, and of the merge that makes a token, with its parts.
        self.rank = {ids[a] << 32 | ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = {ids[a + b]: (k, ids[a], ids[b]) for k, (a, b) in reversed(list(enumerate(pairs)))}
        # parts are made before the whole, as they are where merges were learnt in turn
        self.in_turn = len(self.made) == len(pairs) and all(k > max(self.made.get(x, (-1,))[0] for x in ab) for k, *ab in self.made.values())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.number = {i: str(i) for i in self.by_id}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        #: Runs of letters and runs of other signs are words, but for what follows an apostrophe.
        self.plain_words = self.pattern.pattern == PLAIN_WORDS
        self.split_added = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        tokens = []
        for t, i in self.vocab.items():
            ends = bool(self.end) and t.endswith(self.end) and t != self.end
            body = t.removesuffix(self.end) if ends else t
            if all(c in byte_of for c in body):
                tokens += [(bytes(byte_of[c] for c in body), i, e) for e in ([ends] if self.end else [False, True])]
        self.endings = _Endings(tokens)
        # ids and tokens of words, and of what stands between blanks, each joined by one space
        self.words: dict[str, tuple[str, str]] = {}
        self.chunks: dict[str, tuple[str, str]] = {}
        self.old_words: dict[str, tuple[str, str]] = {}
        self.old_chunks: dict[str, tuple[str, str]] = {}
        self.apart: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[int], list[int]]] = {}

    def normalise(self, text: str) -> str:
        # every kind of white space only separates words here, so it needn't become a blank
        text = unicodedata.normalize("NFC", text)
        # str.lower() makes a final sigma of a capital one at a word's end; the vocabulary's rule goes by the character
        return text.replace("Σ", "σ").lower() if not text.isascii() else text.lower()

    def merge(self, parts: list[int]) -> list[int]:
        """Plain BPE over token ids: the pair of lowest rank merges first, from the left."""
        parts, rank = list(parts), self.rank.get
        while len(parts) > 1:
            ranks = [rank(a << 32 | b, NEVER) for a, b in pairwise(parts)]
            if (low := min(ranks)) == NEVER:
                break
            best = ranks.index(low)
            parts[best : best + 2] = [self.vocab[self.by_id[parts[best]] + self.by_id[parts[best + 1]]]]
        return parts

    def _parts(self, token: int) -> list[int]:
        """The symbols of a token."""
        name = self.by_id[token]
        if self.end and name.endswith(self.end) and name != self.end:
            body = name[: -len(self.end)]
            return [self.vocab[c] for c in [*body[:-1], body[-1] + self.end]]
        return [self.vocab[c] for c in name]

    def _edge(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The token's growing part at its right (``side`` 2) or left (1) edge, from a symbol to the whole, and the rank of each
        next merge (NEVER after the last)."""
        if (found := self.edges.get(token << 2 | side)) is None:
            chain, after = [token], [NEVER]
            while (made := self.made.get(chain[-1])) is not None:
                after.append(made[0])
                chain.append(made[side])
            found = self.edges[token << 2 | side] = chain[::-1], after[::-1]
        return found

    def _meet(self, left: int, right: int) -> bool:
        """Whether no merge ever reaches over the border of two tokens. Merges go by rank, so the parts at the border are at
        each moment those whose next merges rank higher; of one rank, the merge further left is first."""
        (lefts, left_next), (rights, right_next), i, j = self._edge(left, 2), self._edge(right, 1), 0, 0
        while True:
            a, b = left_next[i], right_next[j]
            over = self.rank.get(lefts[i] << 32 | rights[j], NEVER)
            if over < a and over <= b and over < NEVER:
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether token ``left`` (-1: none) followed by ``right`` is encoded as these two tokens; ``left`` alone is."""
        if len(self.apart) > 4 * KEPT:
            self.apart.clear()
        if left < 0 or not self.in_turn:
            want = [i for i in (left, right) if i >= 0]
            found = self.merge([p for t in want for p in self._parts(t)]) == want
        else:
            if (alone := self.apart.get(-1 << 32 | right)) is None:
                alone = self.stays_apart(-1, right)
            found = alone and self._meet(left, right)
        self.apart[left << 32 | right] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Encode new distinct words. Their sorted order is the depth-first order of their trie. Its stack holds, for the first k bytes
        of the path, the last token of their encoding, that token's first place, and the automaton's state."""
        apart, stays, go, step = self.apart.get, self.stays_apart, self.endings.go.get, self.endings.step
        inner, final, number, name = self.endings.inner, self.endings.final, self.number, self.by_id
        before, lasts, starts, states = b"", [-1], [0], [0]
        for path, word in sorted((w.encode(), w) for w in words):
            shared, size = 0, len(path)
            top = min(len(before), size, len(lasts) - 1)
            while shared < top and before[shared] == path[shared]:
                shared += 1
            del lasts[shared + 1 :], starts[shared + 1 :], states[shared + 1 :]
            if shared == size:  # the word is a prefix of the one before: its last place has another ending
                del lasts[size:], starts[size:], states[size:]
                shared -= 1
            state = states[shared]
            for n in range(shared + 1, size + 1):
                if (after := go(state << 8 | path[n - 1])) is None:
                    after = step(state, path[n - 1])
                state = after
                for length, token in (final if n == size else inner)[state]:  # the longest token first
                    at = n - length
                    left = lasts[at]
                    if (fits := apart(left << 32 | token)) is None:
                        fits = stays(left, token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no encoding for {word!r}")
                if n < size:
                    lasts.append(token)
                    starts.append(at)
                    states.append(state)
            tokens = [token]
            while at > 0:
                tokens.append(lasts[at])
                at = starts[at]
            tokens.reverse()
            self.words[word] = " ".join([number[t] for t in tokens]), " ".join([name[t] for t in tokens])
            before = path

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order, and added tokens."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if not any(t in text for t in self.added):
            text = self.normalise(text)
            if self.plain_words and "'" not in text and (core := text.strip(punctuation)).isalpha():  # most often letters with punctuation beside them
                lead, _, tail = text.partition(core)
                return [w for w in (lead, core, tail) if w]
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*self.pattern.findall(self.normalise(text[at : m.start()])), m.group()]
            at = m.end()
        return out + self.pattern.findall(self.normalise(text[at:]))

    def _know(self, wanted: set[str]) -> None:
        """Have the encodings of all these words at hand."""
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > KEPT:
            self.old_words, self.words, new = self.words, {}, wanted
        self.words.update({t: (str(i), t) for t, i in self.added.items()})
        new = new.difference(self.added)
        met = new.intersection(self.old_words)
        self.words.update({w: self.old_words[w] for w in met})
        self.learn(new - met)

    def encode(self, text: str) -> list[int]:
        words = self.pieces(text)
        self._know(set(words))
        return [int(i) for w in words for i in self.words[w][0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, which is what a file without a decoder states."""
        return " ".join([self.by_id[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text, for each text. What stands between blanks is encoded once."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.chunks)
        if len(self.chunks) + len(new) > KEPT:
            self.old_chunks, self.chunks, new = self.chunks, {}, wanted
        met = new.intersection(self.old_chunks)
        self.chunks.update({c: self.old_chunks[c] for c in met})
        # all new words of the piece share one trie
        pieces = [(c, self.pieces(c)) for c in new - met]
        self._know({w for _, words in pieces for w in words})
        known = self.words
        for c, words in pieces:
            if len(words) == 1:
                self.chunks[c] = known[words[0]]
            else:
                found = [known[w] for w in words]
                self.chunks[c] = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
        out, get = [], self.chunks.__getitem__
        for chunks in split:
            found = [x for x in map(get, chunks) if x[0]]  # blanks beside each other leave empty chunks
            ids, back = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return out


@cache
def _loaded(content: bytes) -> WordBpe:
    return WordBpe(content)


def loader(spark: SparkSession, path: str) -> Callable[[], WordBpe]:
    """Gives the file's encoder, one for each worker process. The driver reads the file, so executors need not have it."""
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary, some MB
    return lambda: _loaded(content.value)


def _mapped(load: Callable[[], WordBpe], make: Callable[[WordBpe, list[str]], list[pa.Array]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        gc.disable()  # the caches hold no cycles, and looking for some in them takes a fifth of the time
        for batch in batches:
            texts, start = batch.column(1), 0
            lengths = pc.binary_length(texts).to_pylist()
            while start < batch.num_rows:  # a piece of the batch at a time
                end, size = start, 0
                while end < batch.num_rows and (end == start or size < PIECE):
                    size += lengths[end]
                    end += 1
                part = texts.slice(start, end - start).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *make(bpe, part)], names)
                start = end
        gc.enable()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>``: the ids of each whole text, in the rows' places.

    A null text counts as empty and gives no ids; ids may be null or repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(bpe: WordBpe, texts: list[str]) -> list[pa.Array]:
        return [pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))]

    return rows.mapInArrow(_mapped(loader(docs.sparkSession, path), make, [id_col, "ids"]), f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text``: ids back to text. Null or empty ids give an empty text."""
    rows, load = tokens.select(F.col(id_col), F.col(ids_col)), loader(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of each whole text; nulls and ties as in :func:`encode`."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(bpe: WordBpe, texts: list[str]) -> list[pa.Array]:
        n, ids, back = zip(*bpe.digests(texts), strict=True)
        return [pa.array(n, pa.int64()), pa.array(ids), pa.array(back)]

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(_mapped(loader(docs.sparkSession, path), make, names), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
