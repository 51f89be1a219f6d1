"""Byte-pair encoding and decoding over a trie of words.

Where every merge comes after those that make its parts, a prefix of an encoding is the
encoding of a prefix: the encoding of ``w[:d]`` is that of some ``w[:d - k]`` and one last
token of ``k`` symbols, namely the one token that the token before it never merges into. A
prefix is therefore described by its last token alone. Distinct words are inserted in a
trie in depth-first order; each node's last token follows from those of its ancestors, once
for all words that share the prefix; a leaf's encoding is read back along the path.

Encoding and decoding are maps over batches without a shuffle. Plain Latin text is cut into
words by the tokenizer's rules as one regular expression, other runs without white space by
the library. Each task's tables of words and runs are dropped when they reach ``MAX_WORDS``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillgrid.llm.common import free_name, map_batches, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Runs, words and token pairs that a task remembers, each.
MAX_WORDS = 400_000
#: Longer runs and words are not remembered.
LONG_WORD = 64
#: Bytes of text for one batch of results.
SLICE_BYTES = 4 << 20
#: A symbol that ends a word is its character moved up by this much.
END = 0x10000
#: The rules by which the file cuts words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Characters whose kind and lower case have been fixed since the rules' first Unicode version: Latin letters, without
#: those whose lower case lies elsewhere. "<" is left out, as a special token may begin with it.
PLAIN = [chr(i) for i in range(0x250) if chr(i) != "<" and ord(max(chr(i).lower())) < 0x250]
NOT_PLAIN = re.compile(f"[^{re.escape(''.join(PLAIN))}]")
ASCII_RUNS = re.compile(r"[^ \t\n\r\f\v]+")


def _kind(letter: str) -> str:
    return re.escape("".join(c for c in PLAIN if unicodedata.category(c).startswith(letter)))


#: The words of plain text in lower case, as the file's rules cut it.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_kind('L')}]+|[{_kind('N')}]|[^ \t-\r\x85\xa0{_kind('L')}{_kind('N')}]+")
#: The character that stands for each byte: itself where it is printed, else the next one from U+0100 on.
_shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
BYTE_CHAR = {b: b for b in _shown} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(_shown))}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}
NEVER = 1 << 60


class PairMerges:
    """A vocabulary and its merges over single-character symbols.

    A token's ``ends`` are the symbols that were its last one while it was built, each with
    the rank of the merge that made it and of the one that consumed it; ``starts`` likewise.
    """

    def __init__(self, model: dict) -> None:
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.ends: dict[int, list[tuple[int, int, int]]] = {}
        self.starts: dict[int, list[tuple[int, int, int]]] = {}
        #: Symbols of a token -> its id, for the tokens that merges can make.
        self.tokens: dict[str, int] = {}
        for text, i in vocab.items():
            bare = text.removesuffix(self.suffix) if self.suffix else text
            if len(bare) == 1:
                self._add(chr(ord(bare) + END) if bare != text else bare, i, [(i, -1, NEVER)], [(i, -1, NEVER)])
        for r, (a, b) in enumerate(merges):
            a, b = vocab[a], vocab[b]
            made = vocab[merges[r][0] + merges[r][1]]
            if a not in self.ends or b not in self.ends or made in self.ends:
                raise ValueError(f"merge {r} makes a token twice, or comes before one that makes its parts")
            ends, starts = self.ends[b], self.starts[a]
            self._add(
                self.text[a] + self.text[b],
                made,
                [*ends[:-1], (*ends[-1][:2], r), (made, r, NEVER)],
                [*starts[:-1], (*starts[-1][:2], r), (made, r, NEVER)],
            )
        lengths: dict[str, set[int]] = {}
        for symbols in self.tokens:
            if len(symbols) > 2:
                lengths.setdefault(symbols[-3:], set()).add(len(symbols))
        #: Two symbols that are a token -> (2,).
        self.pairs = {symbols: (2,) for symbols in self.tokens if len(symbols) == 2}
        #: Lengths, from two symbols on, of the tokens that end in three given symbols, longest first.
        self.lengths = {end: (*sorted(n, reverse=True), *self.pairs.get(end[1:], ())) for end, n in lengths.items()}

    text: dict[int, str]

    def _add(self, symbols: str, i: int, ends: list, starts: list) -> None:
        if not hasattr(self, "text"):
            self.text = {}
        self.tokens[symbols], self.text[i], self.ends[i], self.starts[i] = i, symbols, ends, starts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two tokens built side by side.

        A crossing merge needs both symbols to be there when its turn comes. Of two equal
        merges the one further left goes first: it takes the left symbol away from the
        crossing one, while the crossing one takes the right symbol.
        """
        for x, born_x, gone_x in self.ends[left]:
            for y, born_y, gone_y in self.starts[right]:
                r = self.rank.get((x, y))
                if r is not None and born_x < r < gone_x and born_y < r <= gone_y:
                    return False
        return True


class TrieEncoder:
    """Encodes words, given as symbols, by their last tokens along a trie."""

    def __init__(self, merges: PairMerges) -> None:
        self.merges = merges
        self.apart: dict[int, bool] = {}

    def _follow(self, word: str, start: int, last: list[int], size: list[int]) -> None:
        """Sets the last tokens of the prefixes of ``word`` longer than ``start``, given the shorter ones'."""
        m, apart = self.merges, self.apart
        tokens, lengths, shorter = m.tokens.get, m.lengths.get, m.pairs.get
        for depth in range(start + 1, len(word) + 1):
            for n in lengths(word[max(0, depth - 3) : depth]) or shorter(word[max(0, depth - 2) : depth], ()):
                if n > depth:
                    continue
                token = tokens(word[depth - n : depth])
                if token is None:
                    continue
                if n < depth:
                    pair = last[depth - n] << 32 | token
                    fits = apart.get(pair)
                    if fits is None:
                        fits = apart[pair] = m.stay_apart(last[depth - n], token)
                    if not fits:
                        continue
                last[depth], size[depth] = token, n
                break
            else:
                last[depth], size[depth] = tokens(word[depth - 1]), 1

    @staticmethod
    def _read_back(depth: int, last: list[int], size: list[int]) -> list[int]:
        out = []
        while depth:
            out.append(last[depth])
            depth -= size[depth]
        return out[::-1]

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The token ids of distinct words.

        Words are inserted in sorted order, which is the trie's depth-first order. Of its
        nodes only those on the path to the word inserted last are needed again: ``last``
        and ``size`` are that path. An insertion goes back to the node where the words part
        and adds the rest, so that a shared prefix is encoded once.
        """
        if len(self.apart) > MAX_WORDS:
            self.apart.clear()
        out: dict[str, list[int]] = {}
        last, size, before = [0], [0], ""
        for word in sorted(words):
            n = len(word)
            if n >= len(last):
                last += [0] * (n + 1 - len(last))
                size += [0] * (n + 1 - len(size))
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            self._follow(word, shared, last, size)
            out[word] = self._read_back(n, last, size)
            before = word
        return out


class TextEncoder:
    """Texts to token ids: cuts them into words, and encodes all new words of a call in one trie."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges") or not model.get("end_of_word_suffix"):
            raise ValueError("only vocabularies of byte pairs with word ends and without an unknown token or dropout are read")
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError("the file cuts words by other rules")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for their own characters")
        self.trie = TrieEncoder(PairMerges(model))
        self.rules = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Words, and ids of special tokens, to the bytes of their ids (32 bits each).
        self.words: dict[str | int, bytes] = {}
        #: Runs that the library has cut.
        self.runs: dict[str, list[str | int]] = {}

    def _cut_run(self, run: str) -> list[str | int]:
        """The words of a run without ASCII white space, and the ids of special tokens written out in it."""
        at, best = min(((run.find(s), -len(s), s) for s in self.special if s in run), default=(-1, 0, None))[::2]
        if best is not None:
            return [*self._cut_run(run[:at]), self.special[best], *self._cut_run(run[at + len(best) :])]
        if not run:
            return []
        words = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(run))
        return [w.translate(CHAR_BYTE).encode("latin-1").decode() for w, _ in words]

    def cut(self, text: str) -> list[str | int]:
        """The words of a text in order. Runs with a character outside ``PLAIN``, or that may hold a special token, are cut by the library."""
        if not NOT_PLAIN.search(text):
            return WORDS.findall(text.lower())
        runs, out, at = ASCII_RUNS.findall(text), [], 0
        for i in [i for i, run in enumerate(runs) if NOT_PLAIN.search(run)]:
            out += WORDS.findall(" ".join(runs[at:i]).lower())
            run, at = runs[i], i + 1
            words = self.runs.get(run)
            if words is None:
                words = self._cut_run(run)
                if len(run) <= LONG_WORD:
                    self.runs[run] = words
            out += words
        return out + WORDS.findall(" ".join(runs[at:]).lower())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts in a row, and the place where each text begins (and the end)."""
        if len(self.runs) > MAX_WORDS:
            self.runs.clear()
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        known = self.words
        cuts = [self.cut(t or "") for t in texts]
        fresh = set().union(*cuts).difference(known)
        symbols = {}
        for w in fresh:
            if isinstance(w, int):
                known[w] = array("i", [w]).tobytes()
            else:
                s = w.encode().decode("latin-1").translate(BYTE_CHAR)
                symbols[s[:-1] + chr(ord(s[-1]) + END)] = w
        for s, ids in self.trie.encode(symbols).items():
            known[symbols[s]] = array("i", ids).tobytes()
        coded = [b"".join([known[w] for w in words]) for words in cuts]
        for w in fresh:
            if not isinstance(w, int) and len(w) > LONG_WORD:
                del known[w]
        starts = np.zeros(len(texts) + 1, dtype=np.int32)
        np.cumsum([len(c) // 4 for c in coded], out=starts[1:])
        return np.frombuffer(b"".join(coded), dtype=np.int32), starts


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_BYTES`` of text each, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield at, end - at
        at = end


def encode_texts(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", out_col: str = "ids", keep: Iterable[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``out_col`` (array<int>): each text's token ids.

    Ids are those of the ``tokenizers`` library for the file ``path`` without special tokens
    of its own accord; special tokens that are written out in a text are encoded as such.
    Null and empty texts have no ids. Rows are mapped one by one: repeated rows and ids stay,
    an empty table gives an empty one. A column named ``out_col`` (in any case) is replaced;
    all others are left alone, whatever they are called.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out_col.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name(docs, "_text")))

    def run(batches):
        encoder = TextEncoder(path)
        for batch in batches:
            texts = batch.column(len(keep))
            for at, n in _slices(texts):
                ids, starts = encoder.encode(texts.slice(at, n).to_pylist())
                yield pa.record_batch([*[c.slice(at, n) for c in batch.columns[: len(keep)]], pa.ListArray.from_arrays(starts, ids)], names=[*keep, out_col])

    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return map_batches(rows, run, schema)


def decode_ids(rows: DataFrame, path: str = VOCABULARY, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and ``out_col``: the tokens of ``ids_col`` (array<int>) joined as the library's decoder does.

    A file without a decoder joins tokens by a space and keeps word ends; only such files
    are read. Special tokens are written out. Null ids give null, no ids the empty text; an
    id without a token is left out, and so is a null among the ids. A column named
    ``out_col`` (in any case) is replaced.
    """
    keep = [c for c in rows.columns if c.lower() != out_col.lower()]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(ids_col)

    def run(batches):
        rules = Tokenizer.from_file(path)
        if rules.decoder is not None:
            raise ValueError("the file names a decoder")
        by_id = {i: token for token, i in rules.get_vocab(with_added_tokens=True).items()}
        tokens = pa.array([by_id.get(i) for i in range(max(by_id) + 1)])
        for batch in batches:
            ids = batch.column(at)
            flat = ids.flatten()
            flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), flat, None)
            found = tokens.take(flat)
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            if found.null_count:
                kept = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
                starts, found = kept[starts], found.drop_null()
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found), " ")
            yield pa.record_batch([*batch.columns, pc.if_else(ids.is_valid(), text, None)], names=[*keep, out_col])

    return map_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
