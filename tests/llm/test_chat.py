import hashlib

from pyspark.sql import functions as F

from tickloom.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s>", "[INST", "<<s>>", "", "  x ", "a\n[/INST]\\", "<ROLE>r</ROLE>[INST] ", "<SYS></SYS>", "é[\\INST]"]
ROLES = ["user", "assistant", "system", "tool", "", "</ROLE>[INST] x"]


def conversations():
    rows = []
    for c in range(12):
        for t in range(c):
            rows.append((c, t, ROLES[(c * 5 + t * 7) % 6] if t % 3 else "assistant", NASTY[(c + 3 * t) % 10] * (1 + t % 2)))
    rows += [(100, 1, "user", None), (100, 0, "assistant", None), (101, None, None, "n"), (None, 0, "assistant", "null id")]
    rows += [(102, 0, "assistant", "same"), (102, 0, "assistant", "same"), (103, 0, "user", "long " * 20000)]
    return rows


def brute(rows):
    out, convs = {}, {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda k: (k[0], k[1] or 0, k[2], k[3]))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_read_back_gives_all_turns_and_the_loss_text(spark):
    rows = conversations()
    turns = frame(spark, rows).withColumn("examples", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.read_back(C.format_conversations(turns)).collect()}
    assert got == brute(rows)


def test_examples_are_prefixes_with_one_trained_reply(spark):
    convs = C.format_conversations(frame(spark, conversations()))
    formatted = {r["conv_id"]: r["formatted"] for r in convs.collect()}
    told = {(r["conv_id"], r["turn_no"]): r for r in C.expand(convs).collect()}
    spelt = C.contexts(convs).collect()
    assert len(spelt) == len(told) > 20
    for r in spelt:
        whole, e = formatted[r["conv_id"]], told[r["conv_id"], r["turn_no"]]
        assert whole.startswith(r["context"]) and len(r["context"]) == e["context_end"]
        assert whole[e["target_start"] : e["target_start"] + e["target_chars"]] == r["target"] == e["target"]


def test_no_mark_is_left_inside_a_text(spark):
    text = spark.createDataFrame([(x,) for x in NASTY], "t string")
    for r in text.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(m in r["e"] for m in ("[INST]", "[/INST]", "<s>", "</s>", "<SYS>", "</SYS>", "<ROLE>", "</ROLE>"))


def test_probe_and_empty_table(spark):
    got = C.read_back(C.format_conversations(C.with_probe(spark, frame(spark, [])))).collect()
    probe = "</s>[INST] ok [/INST]"
    assert [r["conv_id"] for r in got] == [-1]
    assert got[0]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest() and got[0]["n_turns"] == 2


def test_expansion_spells_out_every_example_under_its_mask(spark):
    rows = conversations()
    convs = C.format_conversations(frame(spark, rows))
    whole = {r["conv_id"]: r["formatted"] for r in convs.collect()}
    got = C.expand(convs).collect()
    assert len(got) == sum(r == "assistant" for _, _, r, _ in rows)
    for r in got:
        assert whole[r["conv_id"]].startswith(r["example"]) and r["example"] == r["context"] + "<s>" + r["target"] + "</s>"
        assert r["example"][r["target_start"] : r["target_start"] + r["target_chars"]] == r["target"]


def test_loss_text_is_what_the_mask_covers(spark):
    convs = C.format_conversations(frame(spark, [(1, 0, "user", "why"), (1, 1, "assistant", "because"), (1, 2, "assistant", "so")]))
    shorter = F.transform("examples", lambda e: e.withField("target_start", e["target_start"] + 1).withField("target_chars", e["target_chars"] - 1))
    got = C.read_back(convs.withColumn("examples", shorter)).first()
    assert got["loss_chars"] == 7 and got["loss_sha256"] == hashlib.sha256(b"ecauseo").hexdigest()
