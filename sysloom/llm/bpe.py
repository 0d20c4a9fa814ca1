"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge can change the tokens before it only through a chain of later merges, each of which
takes the token left of the last change into a right part that begins with it.  The longest
such chain of the merge list, in bytes, is its sufficient lookahead: tokens that end at least
that far before the end of what has been read are the same whatever follows.  A run that the
splitting pattern keeps together is encoded through a window of a few times the lookahead,
and its stable tokens are emitted as soon as they are known, so memory does not grow with
the run.  Decoding is a state machine from bytes to text that holds back an unfinished
character.

Rows: a null or empty text has no token.  Strings of added tokens in a text are these
tokens.  Ties between merges of one rank go to the leftmost, as in the tokenizer file's own
library.  Repeated rows encode alike; an empty table gives an empty result.  The columns of
the result replace input columns of the same name; other columns are kept.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are split and encoded at a time.
SLICE = 1 << 18
#: Runs kept with their tokens; the store is emptied when it is full.
STORED_RUNS = 300_000
_SHORT = 48
# A cut before a single space between two other characters is one that the pattern makes too.
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token no longer depends on what follows."""
    reach: dict[bytes, int] = {}
    most = 0
    for left, right in merges:
        before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), before + len(left))
        most = max(most, reach[left])
    return most


class Runs(dict):
    """Tokens of a run, computed on first use."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, run: str) -> tuple[int, ...]:
        out = tuple(self.encode(run.encode("utf-8", "surrogatepass")))
        if len(run) <= _SHORT:
            if len(self) >= STORED_RUNS:
                self.clear()
            self[run] = out
        return out


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, letters = spec["model"], byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.vocabulary = {as_bytes(t): i for t, i in model["vocab"].items()}
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        self.window = 2 * self.lookahead + 512
        ids = self.vocabulary
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        self.single = [ids[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take in white space are not supported")
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.runs = Runs(self.encode_run)

    def merge(self, data: bytes) -> list[int]:
        """All merges of ``data``, lowest rank first, leftmost first."""
        ids, ranks, none = [self.single[b] for b in data], self.ranks, len(self.merged)
        if len(ids) <= _SHORT:
            rank = [ranks.get(p, none) for p in zip(ids, ids[1:])]
            while rank and (least := min(rank)) != none:
                k = rank.index(least)
                ids[k:k + 2] = [self.merged[least]]
                del rank[k]
                if k < len(rank):
                    rank[k] = ranks.get((ids[k], ids[k + 1]), none)
                if k:
                    rank[k - 1] = ranks.get((ids[k - 1], ids[k]), none)
            return ids
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = [(ranks[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapify(queue)
        while queue:
            _, k, a, b = heappop(queue)
            n = after[k]
            if ids[k] != a or n < 0 or ids[n] != b:
                continue
            ids[k], ids[n] = self.merged[ranks[a, b]], -1
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (pair := (ids[left], ids[right])) in ranks:
                    heappush(queue, (ranks[pair], left, *pair))
        return [i for i in ids if i >= 0]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one run that arrives in blocks, each as soon as it is stable."""
        held = b""
        for block in blocks:
            held += block
            while len(held) > self.window:
                part, end = held[:self.window], 0
                for token in self.merge(part):
                    if end + len(self.bytes_of[token]) > self.window - self.lookahead:
                        break
                    end += len(self.bytes_of[token])
                    yield token
                held = held[end:]
        yield from self.merge(held)

    def encode_run(self, run: bytes) -> Iterable[int]:
        if len(run) <= self.window:
            return self.merge(run)
        return self.stream(run[k:k + self.window] for k in range(0, len(run), self.window))

    def slices(self, text: str) -> Iterator[str]:
        """``text`` in parts that are split as the whole is."""
        at = 0
        while len(text) - at > SLICE:
            cut = _CUT.search(text, at + SLICE)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Token ids of ``text``, in lists."""
        for part in self.slices(text):
            at = 0
            for match in self.special.finditer(part) if self.special and any(t in part for t in self.added) else ():
                yield [*chain.from_iterable(map(self.runs.__getitem__, self.split.findall(part[at:match.start()]))), self.added[match[0]]]
                at = match.end()
            yield list(chain.from_iterable(map(self.runs.__getitem__, self.split.findall(part[at:] if at else part))))

    def decode(self, lists: Iterable[list[int]]) -> Iterator[str]:
        """Text of token ids; an unfinished character waits for its bytes."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in lists:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield machine.decode(b"", True)


def round_trip(docs: DataFrame, definition_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with token count, digest of the ids and digest of the decoded text."""
    with open(definition_path) as f:  # a public vocabulary of fixed size; travels with the plan
        definition = f.read()
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    place = kept.index(text_col)

    def digests(text: str, bpe: Bpe) -> tuple[int, str, str]:
        count, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()

        def tapped() -> Iterator[list[int]]:
            nonlocal count
            for ids in bpe.encode(text):
                if ids:
                    ids_digest.update((b"," if count else b"") + ",".join(map(bpe.decimal.__getitem__, ids)).encode())
                    count += len(ids)
                yield ids

        for piece in bpe.decode(tapped()):
            text_digest.update(piece.encode())
        return count, ids_digest.hexdigest(), text_digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(definition)
        for batch in batches:
            rows = [digests(t.as_py() or "", bpe) for t in batch.column(place)]
            counts, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], [*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)


def token_ids(docs: DataFrame, definition_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    with open(definition_path) as f:
        definition = f.read()
    kept = [c for c in docs.columns if c != ids_col]
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(definition)
        for batch in batches:
            ids = pa.array([list(chain.from_iterable(bpe.encode(t.as_py() or ""))) for t in batch.column(place)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*kept, ids_col])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept, F.array(F.lit(0)).alias(ids_col)).schema)


def texts_of(tokens: DataFrame, definition_path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with the text that the ids decode to."""
    with open(definition_path) as f:
        definition = f.read()
    kept = [c for c in tokens.columns if c != text_col]
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(definition)
        for batch in batches:
            texts = pa.array(["".join(bpe.decode([ids.as_py() or []])) for ids in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*kept, text_col])

    return tokens.select(*kept).mapInArrow(run, tokens.select(*kept, F.lit("").alias(text_col)).schema)
