"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A
visitor walks the parts and flattens them into one string: texts are escaped,
an attachment becomes an ordered placeholder.  It records every attachment's
reference and to how many model tokens its placeholder will expand, and which
stretches of the string are under the loss mask (the texts of assistant
turns).  ``read_back`` inverts the format exactly.

Format: ``<|role|>ROLE\\n CONTENT <|end|>\\n`` per turn (without the spaces);
the k-th attachment of a conversation is ``<|image:k|>`` (or audio, document).

Escaping: every backslash of a text is doubled, and a backslash is put behind
the first character of every control string (``<|``, ``<s>``, ``</s>``,
``<<SYS>>``, ``[INST]``, ...), so none can occur inside an escaped text.  No
original backslash stands alone afterwards, so unescaping is exact.

Rows of a conversation are put in order by turn (null first), then role, then
text, so ties and repeated rows have one order.  Defined cases: a null text
is empty, a null role is the empty role; a turn with no parts has empty
content; a part of an unknown type is an opaque attachment (``<|other:k|>``, one
token) whose reference is its ref, or else its text; texts of any length are taken
whole; an empty table gives no conversations; extra columns are ignored; a
null conversation id is a conversation.  One conversation is one string in
one row by contract; conversations are dealt by id and none is joined with
another.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqlens.llm.common import ship_code

PART_TYPE = ("struct<type:string,text:string,ref:string,width:int,height:int,"
             "seconds:double,pages:int>")

# Expansion of an attachment to model tokens.
IMAGE_PATCH = 28             # pixels along one side of the square that makes one token
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 256

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|role|>", "\n", "<|end|>\n"

#: control strings of this and other common templates (fixed values)
CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPE = re.compile(r"\\|" + CONTROL.pattern)
_UNESCAPE = re.compile(r"\\(\\?)")
_UNESCAPE_ROLE = re.compile(r"\\([\\n]?)")
_TURN = re.compile(r"<\|role\|>(.*?)\n(.*?)<\|end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")
KINDS = ("text", "image", "audio", "document")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """A role is one line: its line ends become a backslash and ``n``."""
    return escape(role).replace("\n", "\\n")


def unescape_role(text: str) -> str:
    return _UNESCAPE_ROLE.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), text)


@dataclass
class Flattener:
    """Visitor over the parts of a conversation."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple] = field(default_factory=list)
    in_loss: bool = False

    def emit(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in KINDS else "visit_other")(part)

    def visit_text(self, part: dict) -> None:
        start = self.length
        self.emit(escape(part.get("text") or ""))
        if self.in_loss and self.length > start:
            self.spans.append((start, self.length))

    def visit_image(self, part: dict) -> None:
        side = lambda v: max(1, math.ceil((v or 0) / IMAGE_PATCH))
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * DOCUMENT_TOKENS_PER_PAGE)

    def visit_other(self, part: dict) -> None:
        ref = part.get("ref")
        self._attach("other", part | {"ref": part.get("text") if ref is None else ref}, 1)

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        k = len(self.attachments)
        self.attachments.append((k, kind, part.get("ref"), n_tokens, self.length))
        self.emit(f"<|{kind}:{k}|>")

    def turn(self, role: str | None, parts) -> None:
        self.emit(ROLE_OPEN + escape_role(role or "") + ROLE_CLOSE)
        self.in_loss = role == "assistant"
        for part in parts if parts is not None else ():
            self.visit(part)
        self.in_loss = False
        self.emit(TURN_END)


def read_back(formatted: str, attachments=()) -> list[tuple[str, list[dict]]]:
    """The (role, parts) list that a formatted conversation was made from.
    Neighbouring texts come back as one part."""
    refs = {a["index"]: a["ref"] for a in attachments}
    turns = []
    for role, content in _TURN.findall(formatted):
        parts, at = [], 0
        for m in _PLACEHOLDER.finditer(content):
            if m.start() > at:
                parts.append({"type": "text", "text": unescape(content[at:m.start()])})
            parts.append({"type": m[1], "ref": refs.get(int(m[2]))})
            at = m.end()
        if at < len(content):
            parts.append({"type": "text", "text": unescape(content[at:])})
        turns.append((unescape_role(role), parts))
    return turns


def text_part(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    empty = {f: F.lit(None).cast(t) for f, t in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[c.alias(n) for n, c in empty.items()])).cast(f"array<{PART_TYPE}>")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in
    code points), attachments (index, kind, ref, n_tokens, at), n_tokens of all
    attachments.  ``parts`` is a list of content parts; default: the column
    ``text`` as one text part."""
    ship_code(turns.sparkSession)
    parts = text_part(F.col("text")) if parts is None else parts
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), parts.alias("parts")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    id_type = dict(whole.dtypes)["conv_id"]
    schema = (f"conv_id {id_type}, formatted string, loss_spans array<struct<start:bigint,stop:bigint>>, "
              "attachments array<struct<index:int,kind:string,ref:string,n_tokens:bigint,at:bigint>>, "
              "attachment_tokens bigint")

    def run(batches):
        for batch in batches:
            made = []
            for turns_ in batch["turns"]:
                f = Flattener()
                for t in turns_:
                    f.turn(t["role"], t["parts"])
                made.append(f)
            yield pd.DataFrame({
                "conv_id": batch["conv_id"],
                "formatted": ["".join(f.out) for f in made],
                "loss_spans": [[{"start": a, "stop": b} for a, b in f.spans] for f in made],
                "attachments": [[dict(zip(("index", "kind", "ref", "n_tokens", "at"), a, strict=True))
                                 for a in f.attachments] for f in made],
                "attachment_tokens": [sum(a[3] for a in f.attachments) for f in made],
            })

    return whole.mapInPandas(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: number of turns, digest
    of role and text of every turn, length and digest of the text under the
    loss mask, length of the string."""
    import hashlib
    ship_code(formatted.sparkSession)
    id_type = dict(formatted.dtypes)["conv_id"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"], strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{''.join(p.get('text', '') for p in parts)}\n" for role, parts in turns)
                loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in spans)
                rows.append((conv, len(turns), sha(said), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars",
                                              "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(
        run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
             "loss_sha256 string, formatted_chars bigint")
