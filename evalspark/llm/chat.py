"""Chat formatting: typed content parts flattened into text with placeholders, a reversible template, a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Each begins with one of the characters that escaping breaks up.
BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[TURN]", "[/TURN]"
ROLE_END = "[TEXT]"

_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"([\\<\[])\\")
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")

FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<begin:long,end:long>>, attachments array<struct<kind:string,ref:string,position:long,tokens:long>>"


def escape(text: str) -> str:
    """Each character that can begin a control string, and the backslash itself, is followed by a backslash; so no
    control string of this or of the usual templates (</s>, <|…|>, [INST]) is left whole."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class PartVisitor:
    """Flattens the typed parts of one turn: text is escaped, attachments become numbered placeholders.

    Expanded tokens of an attachment: images by patches of 14 × 14 merged two by two, audio by 25 tokens a second,
    documents by 256 tokens a page; ``tokens`` in the part itself has priority. Parts of an unknown type keep their
    text; null parts and null texts are empty.
    """

    def __init__(self, first: int = 0):
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.next = first

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        wide, high = (-(-int(part.get(k) or 0) // 28) for k in ("width", "height"))
        self._attach("image", part, wide * high)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, -int(-25 * float(part.get("seconds") or 0) // 1))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, 256 * int(part.get("pages") or 0))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        own = part.get("tokens")
        self.out.append(f"<|{kind}:{self.next}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": self.next, "tokens": int(tokens if own is None else own)})
        self.next += 1


def _parts(content) -> list[dict]:
    return [{"type": "text", "text": content}] if content is None or isinstance(content, str) else list(content)


def _ordered(df: DataFrame, content: str) -> DataFrame:
    """Turns of a conversation together and in order, in one task per conversation; other columns are dropped.

    Order: turn, then role and content, so that repeated and tied rows have a place; null turns come first.
    """
    text = dict(df.dtypes)[content]
    tie = F.col(content) if text == "string" else F.to_json(content)
    turns = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col(content).alias("content"), tie.alias("tie")
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "role", "content")


def format_chats(df: DataFrame, content: str = "text", longest: int = 1 << 22) -> DataFrame:
    """Rows (conv_id, turn, role, content) to formatted conversations; content is a string or an array of typed parts.

    A turn is ``[TURN]role[TEXT]text</s>[/TURN]``; ``<s>`` begins a conversation. ``loss`` has the code-point ranges of
    assistant texts in ``formatted``. A conversation of more than ``longest`` characters goes on in another row with
    the next ``part``, cut between turns, so that no row or task has to hold an endless conversation. Rows with a null
    conv_id form one conversation; a null role is empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        open_row: dict | None = None
        held = 0
        for b in batches:
            for conv, role, value in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["content"].to_pylist(), strict=True):
                fresh = open_row is None or open_row["conv_id"] != conv
                if fresh or open_row["size"] >= longest:
                    if open_row is not None:
                        rows.append(open_row)
                        held += open_row["size"]
                    open_row = {"conv_id": conv, "part": 0 if fresh else open_row["part"] + 1, "n_turns": 0, "pieces": [BEGIN] if fresh else [], "size": len(BEGIN) if fresh else 0, "loss": [], "attachments": [], "next": 0 if fresh else open_row["next"]}
                    if held >= longest:
                        yield _formatted_batch(rows)
                        rows, held = [], 0
                visitor = PartVisitor(open_row["next"])
                for part in _parts(value):
                    visitor.visit(part)
                head, body, tail = OPEN + escape(role) + ROLE_END, "".join(visitor.out), END + CLOSE
                begin = open_row["size"] + len(head)
                if role == "assistant":
                    open_row["loss"].append({"begin": begin, "end": begin + len(body)})
                open_row["pieces"] += [head, body, tail]
                open_row["size"] = begin + len(body) + len(tail)
                open_row["n_turns"] += 1
                open_row["next"] = visitor.next
                open_row["attachments"] += visitor.attachments
        if open_row is not None:
            rows.append(open_row)
        if rows:
            yield _formatted_batch(rows)

    return _ordered(df, content).mapInArrow(run, FORMATTED)


def _formatted_batch(rows: list[dict]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    item = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))
    cols = {
        "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()),
        "part": pa.array([r["part"] for r in rows], pa.int64()),
        "n_turns": pa.array([r["n_turns"] for r in rows], pa.int64()),
        "formatted": pa.array(["".join(r["pieces"]) for r in rows], pa.string()),
        "loss": pa.array([r["loss"] for r in rows], span),
        "attachments": pa.array([r["attachments"] for r in rows], item),
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, unescaped; placeholders stay in the text."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, rest = piece.partition(ROLE_END)
        turns.append((unescape(role), unescape(rest.removesuffix(END + CLOSE))))
    return turns


def digests(chats: DataFrame, placed: bool = False) -> DataFrame:
    """Per conversation, from the formatted text alone: turns, their digest, and length and digest of the text under
    the loss mask. Digests are fed part by part. ``placed``: the parts of a conversation already follow each other in
    one task, as ``format_chats`` leaves them; else they are brought together."""
    if not placed:
        chats = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if now is None or r["part"] == 0:
                    if now is not None:
                        done.append(_closed(now))
                    now = {"conv_id": r["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in read_turns(r["formatted"]):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    learnt = unescape(r["formatted"][span["begin"] : span["end"]])
                    now["loss_chars"] += len(learnt)
                    now["loss"].update(learnt.encode())
                now["chars"] += len(r["formatted"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([_closed(now)], schema=_DIGEST)

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _closed(now: dict) -> dict:
    return {"conv_id": now["conv_id"], "n_turns": now["n"], "turns_sha256": now["turns"].hexdigest(), "loss_chars": now["loss_chars"], "loss_sha256": now["loss"].hexdigest(), "formatted_chars": now["chars"]}


def parts_from_json(column: str, df: DataFrame) -> DataFrame:
    """``df`` with a JSON column of typed parts parsed for ``format_chats``."""
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,tokens:long>>"
    return df.withColumn(column, F.from_json(column, kind))


def placeholders(formatted: str) -> list[tuple[str, int]]:
    """(kind, number) of the placeholders of a formatted text, in order."""
    return [(k, int(n)) for k, n in _PLACE.findall(formatted)]


