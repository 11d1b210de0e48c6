"""Token counts with a whole-token shortcut.

The tokenizer is a BPE piece model with the identity normalizer: blanks become
the mark U+2581 and one mark is put in front of the text.  No piece holds a
mark after another character, so no merge crosses the place where a mark
follows a character, and a text's count is the sum over its pre-tokens (marks
followed by a word).  A line feed takes part in no piece but its own byte, so
pre-tokens are also cut there.

``whole_tokens`` proves once per process, by encoding every vocabulary string
alone, which pre-tokens are a single token; those are counted by one dictionary
probe.  Only the other pre-tokens go through the merge procedure, each distinct
one once per process while the bounded memo holds it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docsift.llm.common import byte_block, chunked, field_type, only, tidy, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
# Distinct merged pre-tokens a worker remembers, and the longest it remembers.
MEMO, MEMO_CHARS = 400_000, 64
BLOCK_BYTES = 4 << 20
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


@functools.lru_cache(maxsize=2)
def _model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


def splittable(name: str = MODEL) -> bool:
    """What the pre-token split rests on, read from the model: the identity
    normalizer keeps every text as it is (the added front mark and escaped
    blanks aside) and no piece joins a character with a following mark or with
    a line feed."""
    model = _model(name)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    probe = "  a ﬁ  b\t "
    return (all(MARK not in p.lstrip(MARK) and "\n" not in p for p in pieces)
            and model.decode(model.encode(probe)) in (probe, " " + probe)
            and model.encode("a")[:1] == [model.piece_to_id(MARK + "a")])


@functools.lru_cache(maxsize=2)
def whole_tokens(name: str = MODEL) -> tuple[frozenset[str], frozenset[str]]:
    """Vocabulary strings that encode alone as exactly one token: words behind
    one mark (given without it) and words behind a line feed."""
    model = _model(name)
    marked, bare = [], []
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(MARK):
            if len(piece) > 1 and piece[1] != MARK:
                marked.append((piece[1:], i))
        else:
            bare.append((piece, i))
    one = {w for (w, i), ids in zip(marked, model.encode([w for w, _ in marked])) if ids == [i]}
    lead = model.encode("\n")  # the front mark and the line feed
    two = {w for (w, i), ids in zip(bare, model.encode(["\n" + w for w, _ in bare])) if ids == [*lead, i]}
    return frozenset(one), frozenset(two)


class _Counter:
    """Token counts of pre-tokens: proven whole tokens first, then merges."""

    def __init__(self, name: str):
        self.model = _model(name)
        self.cut = splittable(name)
        self.lead = len(self.model.encode("\n"))
        self.whole = whole_tokens(name)
        self._reset()

    def _reset(self) -> None:
        self.marked = dict.fromkeys(self.whole[0], 1)   # word behind one mark
        self.bare = dict.fromkeys(self.whole[1], 1)     # word behind a line feed
        self.bare[""] = 0
        self.marked[""] = 1                             # a mark alone

    def _merge(self, words: set[str], known: dict[str, int], front: str, less: int) -> dict[str, int]:
        missing = [w for w in words if w not in known]
        counts = [len(x) - less for x in self.model.encode([front + w for w in missing])] if missing else []
        extra = {}
        for w, n in zip(missing, counts):
            (known if len(w) <= MEMO_CHARS else extra)[w] = n
        return extra

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text; an empty text has none."""
        if not self.cut:
            return [len(x) for x in self.model.encode(texts)] if texts else []
        if len(self.marked) + len(self.bare) > MEMO:
            self._reset()
        heads, tails, runs = [], [], []
        for text in texts:
            if not text:
                heads.append(())
                tails.append(())
                runs.append(())
                continue
            if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
                # runs of marks: a pre-token is the whole run and its word
                words, odd = [], []
                for x in _RUNS.findall(MARK + text.replace(" ", MARK)):
                    first, *rest = x.split("\n")
                    word = first.lstrip(MARK)
                    if word and len(first) - len(word) == 1:
                        words.append(x[1:])
                    else:
                        odd.append(first)
                        words.extend(("\n", r) for r in rest)
                runs.append(tuple(odd))
                tail = [w[1] for w in words if isinstance(w, tuple)]
                words = [w for w in words if isinstance(w, str)]
            else:
                runs.append(())
                tail, words = [], text.split(" ")
            if "\n" in text:
                plain = []
                for w in words:
                    if "\n" in w:
                        first, *rest = w.split("\n")
                        plain.append(first)
                        tail.extend(rest)
                    else:
                        plain.append(w)
                words = plain
            heads.append(words)
            tails.append(tail)
        long_heads = self._merge(set().union(*heads), self.marked, "", 0)
        long_tails = self._merge(set().union(*tails), self.bare, "\n", self.lead)
        odd = sorted(set().union(*runs))
        odd_counts = dict(zip(odd, map(len, self.model.encode([x[1:] for x in odd])))) if odd else {}
        if MARK in odd_counts:  # the front mark alone, before a line feed
            odd_counts[MARK] = 1
        marked = self.marked if not long_heads else {**self.marked, **long_heads}
        bare = self.bare if not long_tails else {**self.bare, **long_tails}
        return [sum(map(marked.__getitem__, h)) + sum(map(bare.__getitem__, t)) + len(t) + sum(map(odd_counts.__getitem__, r))
                for h, t, r in zip(heads, tails, runs)]


@functools.lru_cache(maxsize=2)
def _counter(name: str) -> _Counter:
    return _Counter(name)


def count_texts(texts: list[str], model: str = MODEL) -> list[int]:
    """Token counts of some texts in this process."""
    return _counter(model).count(texts)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 model: str = MODEL) -> DataFrame:
    """One row per input row: id, UTF-8 length ``n_bytes``, ``n_tokens`` and
    ``over_limit`` (``n_tokens > limit``).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows are counted each; an empty table gives no rows.  Other
    columns are not read.  No shuffle: a task counts what it reads."""
    schema = T.StructType([T.StructField("doc_id", field_type(docs, id_col)), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in chunked(batches, BLOCK_BYTES):
            _, offsets = byte_block(batch.column(1))
            n = np.array(counter.count([t or "" for t in batch.column(1).to_pylist()]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                                             names=schema.names)

    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(tidy(run), schema)
