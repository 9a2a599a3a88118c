"""SentencePiece encoding and decoding on the `tokenizers` library.

The model file is parsed as protobuf and rebuilt: normaliser, metaspace marker,
scores (unigram log-probabilities, or merge ranks in a BPE model) and byte
fallback. Batches are encoded by several threads. Long texts are cut before a
metaspace run into parts of about PART characters, which keeps the merge heap
small. No piece of the model may reach across such a cut (checked when the
model is read; with such pieces, or a unigram model, texts go in whole), so the
ids of a text are those of its parts in order.

Every text is decoded again, by a table of the pieces' bytes, and compared with
its normal form, and encoded again by the sentencepiece library, whose ids are
compared with its own (parity). Equal texts of a batch are worked on once.

Defined results: null gives null ids and no tokens; empty text gives no ids;
texts are read whole; equal texts give equal ids; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import by_bytes, quoted

MARK = "▁"
PART = 1000
THREADS = 2


def default_model() -> str:
    """The public BPE model with byte fallback on this machine."""
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def parse_model(path: str):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


def _merges(proto) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; among equal scores, the shorter ids first."""
    plain = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
    found = [(-proto.pieces[i].score, plain[p[:k]], plain[p[k:]], p[:k], p[k:])
             for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
    return [f[3:] for f in sorted(found)]


def build(proto, normalise: bool = True) -> Tokenizer:
    """A Tokenizer equal to the model. Without `normalise` it takes text that carries its marks already."""
    spec, trained = proto.normalizer_spec, proto.trainer_spec
    if trained.model_type == 1:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=trained.unk_id, byte_fallback=trained.byte_fallback)
    else:
        vocab = {p.piece: i for i, p in enumerate(proto.pieces)}
        model = models.BPE(vocab, _merges(proto), unk_token=proto.pieces[trained.unk_id].piece, fuse_unk=True, byte_fallback=trained.byte_fallback)
    out = Tokenizer(model)
    if normalise:
        steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        steps += [normalizers.Prepend(MARK)] if spec.add_dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *(strip if normalise else [])])
    return out


class Codec:
    """Encodes and decodes texts with one model."""

    def __init__(self, path: str):
        proto = parse_model(path)
        self.full, self.core = build(proto), build(proto, normalise=False)
        self.exact = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.normalizer_spec
        #: marks take the place of blanks and nothing else changes
        self.plain = spec.add_dummy_prefix and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        self.in_parts = self.plain and proto.trainer_spec.model_type == 2 and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.bytes_of = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.unknown = proto.trainer_spec.unk_id

    def parts(self, text: str) -> list[str]:
        """The normalised text in parts of about PART characters, each from a run of marks on."""
        text = MARK + text.replace(" ", MARK)
        out, start = [], 0
        while len(text) - start > 2 * PART:
            cut = text.find(MARK, start + PART)
            while cut > 0 and text[cut - 1] == MARK:
                cut = text.find(MARK, cut + 1)
            if cut < 0:
                break
            out.append(text[start:cut])
            start = cut
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.in_parts:
            return [np.array(e.ids, np.int32) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.parts(t) if t else [] for t in texts]
        got = iter(self.core.encode_batch_fast([p for parts in cut for p in parts], add_special_tokens=False))
        return [np.array([i for _ in parts for i in next(got).ids], np.int32) for parts in cut]

    def gives_back(self, text: str, ids: np.ndarray) -> bool:
        """Whether the pieces' bytes, joined, are the text's normal form; an unknown piece cannot be."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        form = (MARK + text.replace(" ", MARK) if text else "") if self.plain else self.full.normalizer.normalize_str(text)
        return joined == form.encode()

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.full.decode_batch(ids, skip_special_tokens=False)

    def same(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether sentencepiece gives the same ids, for every text."""
        return [i.tolist() == want for i, want in zip(ids, self.exact.encode(texts, num_threads=1))]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per process and model; workers are reused between tasks."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def share_model(docs: DataFrame, path: str | None) -> str:
    """Sends the model file to every executor and returns the name it has there."""
    path = path or default_model()
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


FIELDS = "ids array<int>, n_tokens long, n_byte_tokens long, n_unknown long, round_trip boolean, parity boolean"


def encode_table(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """`key` and the FIELDS of every row of `docs`; parity is null for null texts only."""
    name = share_model(docs, model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(SparkFiles.get(name))
        for batch in by_bytes(batches, "text", 2 << 20):
            given = batch.column("text").to_pylist()
            at = {t: k for k, t in enumerate(dict.fromkeys(t or "" for t in given))}
            texts, rows = list(at), [at[t or ""] for t in given]
            once = coder.encode(texts)
            back, same = [coder.gives_back(t, i) for t, i in zip(texts, once)], coder.same(texts, once)
            ids = [once[k] for k in rows]
            sizes = np.array([len(i) for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()),
                                             mask=pa.array([t is None for t in given]))
            counts = [sizes, [int(coder.is_byte[i].sum()) for i in ids], [int((i == coder.unknown).sum()) for i in ids]]
            parity = [None if t is None else same[k] for t, k in zip(given, rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, *(pa.array(c, pa.int64()) for c in counts), pa.array([back[k] for k in rows], pa.bool_()), pa.array(parity, pa.bool_())],
                [key, *(f.split()[0] for f in FIELDS.split(", "))])

    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(run, f"{quoted(key)} {kind}, {FIELDS}")


def decode_table(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """`key` and the decoded `text` of every row; null ids give null."""
    name = share_model(encoded, model)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(SparkFiles.get(name))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.column(1).to_pylist()
                texts = iter(coder.decode([r for r in rows if r is not None]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if r is None else next(texts) for r in rows], pa.string())], [key, "text"])

    return encoded.select(encoded[key].alias("id"), encoded[ids].alias("ids")).mapInArrow(run, f"{quoted(key)} {kind}, text string")
