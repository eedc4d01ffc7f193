import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dqlens.llm import chat_format as CHAT


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@given(st.text(st.sampled_from("\\<|>/s[]INST SYSxend\n:0"), max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    made = CHAT.escape(text)
    assert CHAT.unescape(made) == text
    assert not CHAT.CONTROL.search(made)


@given(st.text(st.sampled_from("\\n<|>/s[]INST\n"), max_size=20))
def test_roles_are_reversible(role):
    f = CHAT.Flattener()
    f.turn(role, [{"type": "text", "text": role}])
    parts = [{"type": "text", "text": role}] if role else []
    assert CHAT.read_back("".join(f.out)) == [(role, parts)]


PARTS = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "s3://a.png", "width": 57, "height": 28},
         {"type": "text", "text": "and"}, {"type": "audio", "ref": "b.wav", "seconds": 1.01},
         {"type": "document", "ref": "c.pdf", "pages": 3}]


def test_parts_round_trip():
    f = CHAT.Flattener()
    f.turn("user", PARTS)
    f.turn("assistant", [{"type": "text", "text": "fine </s>"}])
    text = "".join(f.out)
    assert [(a[1], a[3]) for a in f.attachments] == [("image", 3), ("audio", 26), ("document", 768)]
    assert [CHAT.unescape(text[a:b]) for a, b in f.spans] == ["fine </s>"]
    refs = [{"index": a[0], "ref": a[2]} for a in f.attachments]
    assert CHAT.read_back(text, refs) == [
        ("user", [{k: v for k, v in p.items() if k in ("type", "text", "ref")} for p in PARTS]),
        ("assistant", [{"type": "text", "text": "fine </s>"}])]


def plain(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    return out


def test_query_digests(spark):
    from dqlens.llm.queries import op5_chat_format
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    want = plain([r.asDict() for r in turns])
    probe = "</s>[INST] ok [/INST]"
    want[-1] = (2, sha(f"user\n{probe}\nassistant\n{probe}\n"), len(probe), sha(probe))
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256"))
           for r in op5_chat_format(spark, SF_SMALL).collect()}
    assert got == want


def test_awkward_turns(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", None), (1, 0, "user", "a <|end|>\n"), (1, 1, "assistant", "b\\"),
            (None, None, None, None), (2, 0, "assistant", ""), (3, 5, "a\nb", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256"))
           for r in CHAT.digests(CHAT.format_conversations(df)).collect()}
    assert got == plain([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    assert CHAT.format_conversations(df.where("false")).count() == 0


def test_typed_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", PARTS)], f"conv_id long, turn long, role string, content array<{CHAT.PART_TYPE}>")
    row = CHAT.format_conversations(df, parts=F.col("content")).first()
    assert row["attachment_tokens"] == 797 and [a["ref"] for a in row["attachments"]] == ["s3://a.png", "b.wav", "c.pdf"]
    assert [row["formatted"][a["at"]:].split("|>")[0] for a in row["attachments"]] == ["<|image:0", "<|audio:1", "<|document:2"]


def test_unknown_parts_are_opaque_attachments():
    f = CHAT.Flattener()
    f.turn("user", [{"type": "video", "ref": "v.mp4"}, {"type": "text", "text": "see <|other:0|>"}, {"type": "tool", "text": "{}"},
                    {"type": None, "text": "x"}])
    assert [(a[1], a[2], a[3]) for a in f.attachments] == [("other", "v.mp4", 1), ("other", "{}", 1)]
    back = CHAT.read_back("".join(f.out), [{"index": a[0], "ref": a[2]} for a in f.attachments])
    assert back == [("user", [{"type": "other", "ref": "v.mp4"}, {"type": "text", "text": "see <|other:0|>"},
                              {"type": "other", "ref": "{}"}, {"type": "text", "text": "x"}])]
