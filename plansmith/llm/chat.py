"""Chat formatting by token-level assembly.

A turn is its role's control id (or the generic role id, the role's name as text and the separator id), the text, and the
end id. Roles and texts are encoded segment by segment as ordinary text, so that no content can give a control id, and
reserved ids behind the vocabulary are spliced in between. The loss mask is the prefix sum of marks set where assistant
texts begin and end. In the readable form control ids are the strings of ``CONTROL``; those strings, and other templates'
control strings, are escaped where contents hold them: a backslash follows their first character, and backslashes are
doubled, which ``unescape`` undoes.

Encoding runs on the rows as they lie. Encoded turns are then dealt by conversation and sorted by turn, and assembly streams
them: a conversation becomes one or more rows, each of whole turns and at most about ``PIECE`` tokens, so that no long
conversation is held in memory. The vocabulary file is read on the driver and broadcast; its size is fixed.

Defined results: null texts and null roles are empty; rows of a null conv_id are one conversation; equal turns order by role
and then by their tokens, null turns first; repeated rows are turns of their own; a conversation without assistant texts has
an empty loss text; extra columns are left alone; an empty table leaves only what is added to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE = 1 << 15
SEGMENT = 1 << 12
#: Reserved ids follow the vocabulary in this order.
CONTROL = ("<|system|>", "<|user|>", "<|assistant|>", "<|role|>", "<|sep|>", "<|end|>")
ROLES = ("system", "user", "assistant")
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_CONTROLS = re.compile("(?=" + "|".join(map(re.escape, CONTROL + FOREIGN)) + ")(.)")
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: A blank between what is no space and an ASCII letter always begins a word of the pattern.
_BREAK = re.compile(r"(?<=\S) (?=[A-Za-z])")


def escape(text: str) -> str:
    return _CONTROLS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


class Codec:
    """Ordinary text to ids and back. Long texts are encoded in pieces cut where the pattern begins a new word anyway, so that
    their ids are those of the whole."""

    def __init__(self, vocabulary: bytes):
        self.vocabulary = vocabulary
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.base = max(self.ranks.values()) + 1
        self._encoding = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.__init__(state["vocabulary"])

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("content", pat_str=_PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        while len(text) - at > SEGMENT:
            cut = _BREAK.search(text, at + SEGMENT)
            if cut is None:
                break
            out += self.encoding.encode_ordinary(text[at : cut.start()])
            at = cut.start()
        return out + self.encoding.encode_ordinary(text[at:] if at else text)

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def control(self, name: str) -> int:
        return self.base + CONTROL.index(name)


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> Codec:
    with open(path, "rb") as f:  # on the driver
        return Codec(f.read())


def turn_ids(c: Codec, role: str, text: str) -> tuple[list[int], int, int]:
    """A turn's ids, and where its text begins and ends among them."""
    head = [c.control(f"<|{role}|>")] if role in ROLES else [c.control("<|role|>"), *c.encode(escape(role)), c.control("<|sep|>")]
    body = c.encode(escape(text))
    return [*head, *body, c.control("<|end|>")], len(head), len(head) + len(body)


_TURN = "conv_id long, turn long, role string, ids array<int>, a int, b int"
_PIECES = "conv_id long, piece long, n_turns long, token_ids array<int>, loss_mask array<byte>"


def format_conversations(conversations: DataFrame, vocabulary: str = VOCABULARY, piece: int = PIECE) -> DataFrame:
    """conv_id, piece (from 0), n_turns, token_ids, loss_mask. A conversation's pieces lie in order in one partition."""
    spark = conversations.sparkSession
    held = ship(spark, codec(vocabulary))

    def encode(batches):
        c = held()
        for b in batches:
            roles = [r or "" for r in b.column("role").to_pylist()]
            got = [turn_ids(c, r, t or "") for r, t in zip(roles, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["conv_id", "turn", "role", "ids", "a", "b"])

    def assemble(batches):
        conv, n_piece, turns, size = object(), 0, [], 0

        def flush():
            ids = np.concatenate([t[0] for t in turns])
            marks = np.zeros(len(ids) + 1, np.int8)
            at = 0
            for t, learn, a, b in turns:
                if learn:
                    marks[at + a] += 1
                    marks[at + b] -= 1
                at += len(t)
            mask = np.cumsum(marks[:-1], dtype=np.int8)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (pa.array(ids, pa.int32()), pa.array(mask, pa.int8()))]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n_piece], pa.int64()), pa.array([len(turns)], pa.int64()), *lists], names=["conv_id", "piece", "n_turns", "token_ids", "loss_mask"])

        for b in batches:
            ids = b.column("ids")
            for k, (cid, role, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "a", "b")), strict=True)):
                t = ids[k].values.to_numpy(zero_copy_only=False)
                if turns and (cid != conv or size + len(t) > piece):
                    yield flush()
                    n_piece = n_piece + 1 if cid == conv else 0
                    turns, size = [], 0
                elif cid != conv:
                    n_piece = 0
                conv = cid
                turns.append((t, role == "assistant", x, y))
                size += len(t)
        if turns:
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = rows.mapInArrow(encode, _TURN).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return turns.mapInArrow(assemble, _PIECES)


def parse(c: Codec, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
    """(role, text, text under the mask) of each turn, from whole turns' ids."""
    out, last, role = [], 0, ""
    names = {c.control(x): x for x in CONTROL}
    for i in np.flatnonzero(ids >= c.base).tolist():
        name = names[int(ids[i])]
        if name == "<|sep|>":
            role = unescape(c.decode(ids[last:i].tolist()))
        elif name == "<|end|>":
            text = unescape(c.decode(ids[last:i].tolist()))
            under = mask[last:i]
            out.append((role, text, text if len(under) and under.all() else unescape(c.decode(ids[last:i][under.astype(bool)].tolist()))))
        elif name != "<|role|>":
            role = name[2:-2]
        last = i + 1
    return out


def readable(c: Codec, ids: np.ndarray) -> str:
    """The formatted text of the ids."""
    out, last = [], 0
    for i in np.flatnonzero(ids >= c.base).tolist():
        out += [c.decode(ids[last:i].tolist()), CONTROL[int(ids[i]) - c.base]]
        last = i + 1
    return "".join([*out, c.decode(ids[last:].tolist())])


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the formatted conversations say, read back from ids and masks."""
    held = ship(formatted.sparkSession, codec(vocabulary))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        c, conv, begun = held(), None, False
        n = chars = loss = 0
        turns, learnt = hashlib.sha256(), hashlib.sha256()
        out: list = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

        for b in batches:
            ids, masks = b.column("token_ids"), b.column("loss_mask")
            for k, (cid, piece) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), strict=True)):
                if piece == 0:
                    if begun:
                        out.append((conv, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))
                    conv, begun, n, chars, loss = cid, True, 0, 0, 0
                    turns, learnt = hashlib.sha256(), hashlib.sha256()
                x, m = ids[k].values.to_numpy(zero_copy_only=False), masks[k].values.to_numpy(zero_copy_only=False)
                for role, text, under in parse(c, x, m):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    learnt.update(under.encode())
                    loss += len(under)
                chars += len(readable(c, x))
            if len(out) > 5000:
                yield batch()
                out = []
        if begun:
            out.append((conv, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))
        if out:
            yield batch()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_conversations(rows.unionByName(more)))


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for x in CONTROL + FOREIGN:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


ORACLE_SQL = {
    "op2_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped_sql('text')}) + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 4 ELSE 15 + length({_escaped_sql('role')}) END + 7) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
