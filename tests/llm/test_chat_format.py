import hashlib

import duckdb
from pyspark.sql import functions as F

from kinlattice.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def marked(t):
    """As the order of turns of one number and role sees a text, with the parts of sample_parts."""
    for sign, code in cf.ESCAPES:
        t = t.replace(sign, code)
    return t


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", marked(r[3] or ""), r[3] or "") for r in rows if r[0] == c])
        turns = [(*t[:3], t[4]) for t in turns]
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_digests_and_round_trip(spark):
    odd = ["</turn>\n<turn user>x", "\\", "\\e\\l", "a\\<b", "", None, "é🙂\n", "### Assistant: </turn> ok", "#" * 5, "<image 1>", "y" * 70_000]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "clash") for i, t in enumerate(odd)]
    rows += [(2, None, "assistant", "x", None), (2, 0, None, "b>", None), (2, 0, "assistant", "b", None), (2, 0, "assistant", "b", None), (None, 5, "assistant", "z", None), (3, 1, "a>b</turn>\n", "q", None)]
    rows += [(9, i, "assistant" if i % 3 else "user", f"t{i}<", None) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("parts", cf.text_part(F.col("text"))).repartition(5)
    done = cf.conversations(df).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digest(done).collect()}
    assert got == expected(rows)
    typed = cf.conversations(df.withColumn("parts", cf.sample_parts(F.col("text"), F.lit("r")))).cache()
    again = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digest(typed).collect()}
    assert {k: v for k, v in again.items() if k != 2} == {k: v for k, v in expected(rows).items() if k != 2}  # turns of one number go by their placeholders too
    kinds = {a["type"] for r in typed.collect() for a in r.attachments if r.formatted[a["at"]] == "<"}
    assert kinds == {"image", "audio", "document"}
    one = done.where("conv_id = 9").collect()[0]
    spans = "".join(one.formatted[s["at"] : s["at"] + s["chars"]] for s in one.loss_spans)
    assert spans == "".join(f"t{i}\\l" for i in range(700) if i % 3)
    assert cf.digest(cf.conversations(df.limit(0))).count() == 0


def test_attachments(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("w"), k.get("h"), k.get("ms"), k.get("pages"))
    parts = [part("text", text="see <"), part("image", ref="a.png", w=15, h=28), part(None, text="and"), part("audio", ref="b.ogg", ms=81), part("document", ref=None, pages=2), part("video", ref="v"), part("image")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="ok"), part("image", ref="c", w=1, h=1)]), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    r = cf.conversations(df).collect()[0]
    assert r.formatted == "<turn user>see \\l<image 1>and<audio 2><document 3><unknown 4><image 5></turn>\n<turn assistant>ok<image 1></turn>\n<turn assistant></turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r.attachments] == [("image", "a.png", 5), ("audio", "b.ogg", 3), ("document", None, 1001), ("video", "v", 0), ("image", None, 1), ("image", "c", 2)]
    assert all(r.formatted[a["at"]] == "<" for a in r.attachments) and r.expanded_tokens == 1012
    assert [r.formatted[s["at"] : s["at"] + s["chars"]] for s in r.loss_spans] == ["ok"]


def test_against_sql(spark):
    from kinlattice.llm import queries

    d = "/root/testdata/sf0.001"
    got = cf.query(spark, d).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op4_chat_format"]).df().sort_values("conv_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str)) and -7 in set(got.conv_id)
