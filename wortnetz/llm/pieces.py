"""Operator 5, SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, spread, table

#: What the library writes for a space.
SPACE = "▁"
#: Segments whose ids a worker remembers.
REMEMBERED = 300_000
#: Texts of so many characters or fewer keep their agenda in a list.
SHORT = 48
NEVER = float("inf")


class Vocabulary:
    """A merge-type (BPE) model file, for identity normalisation with a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback:
            raise ValueError("not a merge-type model with plain normalisation, dummy prefix and byte fallback")
        kinds = {p.type for p in proto.pieces}
        if kinds - {1, 2, 3, 6}:
            raise ValueError("user-defined or unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.minus_score = {p.piece: -p.score for p in proto.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        # a piece with a space mark after another character would join words; without one, words are merged apart
        self.words_apart = not any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids)
        self.lines_apart = not any("\n" in p for p in self.ids)
        #: Ids of words as bytes of 32-bit integers; what is not met for a while goes to older, and then is forgotten.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marked: the pair with the best score is merged first, the leftmost of ties."""
        return self._ids(self._merge_short(text) if len(text) <= SHORT else self._merge_long(text))

    def _merge_short(self, text: str) -> list[str]:
        """The agenda as a list with one place per adjacent pair: for words, its least entry is found faster than a heap's."""
        get, symbols = self.minus_score.get, list(text)
        agenda = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) is not NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """The agenda as a heap over linked symbols."""
        symbols: list[str | None] = list(text)
        score, n = self.minus_score, len(symbols)
        agenda = [(s, i, pair) for i in range(n - 1) if (s := score.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                grown = pair + symbols[k]
                if (s := score.get(grown)) is not None:
                    heapq.heappush(agenda, (s, i, grown))
            if (h := before[i]) >= 0:
                grown = symbols[h] + pair
                if (s := score.get(grown)) is not None:
                    heapq.heappush(agenda, (s, h, grown))
        return [s for s in symbols if s is not None]

    def _ids(self, symbols: list[str]) -> list[int]:
        out = list(map(self.ids.get, symbols))
        if None in out:  # characters that are no piece are spelled in bytes
            out = [i for s, i in zip(symbols, out) for i in ([i] if i is not None else [self.bytes[b] for b in s.encode()])]
        return out

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as 32-bit integers, without an end id.

        A batch's words that are new to this worker are merged by the agenda and checked against the library; texts in
        which words cannot be told apart are merged and checked as wholes. A difference is an error, never passed over.
        """
        split: list[list[str] | None] = []
        for t in texts:
            plain = self.words_apart and self.lines_apart and t and "  " not in t and t[0] not in " \n" and SPACE not in t
            split.append(t.replace("\n", " \n").split(" ") if plain else None)
        self.learn(set().union(*filter(None, split)))
        find, out = self.known.__getitem__, []
        for t, ws in zip(texts, split):
            if ws:
                out.append(np.frombuffer(b"".join(map(find, ws)), "<i4"))
            else:
                ids = self.whole(t) if t else ()
                out.append(np.array(ids, "<i4"))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [a.tolist() for a in self.arrays(texts)]

    def learn(self, words: set[str]) -> None:
        """Puts the words' ids into ``known``. Words that were not met for a while are forgotten, so memory is bounded by
        twice REMEMBERED and one batch, and frequent words stay."""
        if len(self.known) + len(words) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = []
        for w in words.difference(known):
            ids = older.pop(w, None)
            if ids is None:
                fresh.append(w)
            else:
                known[w] = ids
        lone, merge = [self.ids[SPACE]], self.merge
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            for w, theirs in zip(part, self.library.encode(part, num_threads=1)):
                if w[:1] == "\n":  # no space before it: the library's dummy prefix stands alone
                    ours, theirs = merge(w), theirs[1:]
                else:  # the library gives nothing for an empty text, not even a prefix
                    ours, theirs = merge(SPACE + w), theirs or lone
                if ours != theirs:
                    self.check(w, ours, theirs)
                known[w] = array("i", ours).tobytes()

    def whole(self, text: str) -> list[int]:
        marked = SPACE + text.replace(" ", SPACE)
        parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked) if self.words_apart else [marked]
        ours = [i for p in parts for i in self.merge(p)]
        self.check(text, ours, self.library.encode(text))
        return ours

    @staticmethod
    def check(text: str, ours, theirs) -> None:
        if list(ours) != list(theirs):
            raise ValueError(f"agenda and library differ on {text[:80]!r}")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One instance per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encoded(column: Column, path: str) -> Column:
    """struct(ids, decoded): ids of each whole text, the end id last, and the text that the library's decode makes of them.
    Null counts as empty, whose only id is the end."""

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for texts in parts:
            ids = [np.append(a, np.int32(v.end)) for a in v.arrays(texts.tolist())]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([v.library.decode(a.tolist()) for a in ids], dtype=object)})

    return encode(F.coalesce(column, F.lit("")))


def decoded(column: Column, path: str) -> Column:
    """The text of an array of ids, as the library's decode gives it; null where the array is null."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = vocabulary(path).library
        for rows in parts:
            yield pd.Series([None if ids is None else library.decode(ids.tolist()) for ids in rows], index=rows.index, dtype=object)

    return decode(column)


def encode_texts(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with the columns ids (array<int>) and decoded (string); a repeated text is encoded each time, an empty table
    gives no rows. Columns of those two names are replaced, all others stay."""
    bound_batches(df.sparkSession, 512)
    out = spread(df.drop("ids", "decoded")).withColumn("__e", encoded(F.col(text_col), path))
    return out.withColumns({"ids": F.col("__e.ids"), "decoded": F.col("__e.decoded")}).drop("__e")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, encoded and decoded again. Null and empty texts have the end id alone; repeated rows stay, each with
    the same result; a table without rows gives none."""
    import public_tokenizers

    rows = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
