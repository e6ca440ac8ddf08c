"""Packing, sharding, archives, languages, pieces, top-k and chat."""

import base64
import hashlib

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import chat, langid, packing, pieces, sharding, topk, warc
from shutterlake.llm.common import table

SMALL = "/root/testdata/sf0.001"


# packing
def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path)
    texts = ["", "it's I'LL <|endoftext|> x<|startoftext|>y", "á e ́x", "ΟΔΟΣ İstanbul ǆ", "a b c\x1cd\x85e\tf\r\ng  h\n\n", "日本語 🙂🙂", "' s 're", "a‍b c̀", "ﬁ Å " * 50]
    for t in texts:
        assert packing.text_ids(t, path) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_letters_go_to_the_model_alone():
    """Runs of plain letters are encoded without the tokenizer's splitting, with the same ids."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, cache = Tokenizer.from_file(path), packing.WordIds(path)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    odd = ["STRASSE", "Straße,", "ÀÉÍ!!", "µm", "ªº", "ÿ;", "don't", "a<|endoftext|>b", "a<|", "İs", "ŒUVRE", "á\u0338", "x\u0338,", "q\xadr", "5a", "a5,", "÷", ",,,", "''s", "word's."]
    stretches = set(letters) | {c + c + "," for c in letters} | {c + "x." for c in letters} | set(odd)
    asked = []
    cache.tokenizer = type("", (), {"encode": lambda _, text, **how: asked.append(text) or whole.encode(text, **how)})()
    cache.learn(stretches)
    for word in stretches:
        assert cache[word] == np.array(whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word
    assert not {w for text in asked for w in text.split(" ")} & {"STRASSE", "Straße,", "ÀÉÍ!!", "µm", "a<|"}


def test_known_letters_are_not_encoded_again():
    """Stretches whose letters are known in lower case and without marks take their ids, from either generation."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, cache = Tokenizer.from_file(path), packing.WordIds(path)
    asked, model = [], cache.model
    cache.model = type("", (), {"tokenize": lambda _, text: asked.append(text) or model.tokenize(text)})()
    cache.learn({"wordlet", "étude"})
    cache.older = dict(cache)
    cache.clear()
    cache.learn({"other"})
    stretches = {"Wordlet", "WORDLET,", "wordlet!?", "Étude.", "OTHER;", "Other", "other,"}
    cache.learn(stretches)
    assert len(asked) == 3
    for word in stretches:
        assert cache[word] == np.array(whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word


def check_packing(rows, tokens):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by)


def test_packing_of_the_small_table(spark):
    rows = packing.op2(table(spark, SMALL, "documents")).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 2048) <= -(-total // 2048) * 1.02 + 1
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for own in by.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert all(n == 2048 for _, _, n in own[:-1]) and [s for _, s, _ in own] == [2048 * k for k in range(len(own))]


def test_packing_keeps_every_capacity():
    random.seed(2)
    lengths = Counter(random.randrange(1, 170) for _ in range(3000))
    for rule in ("residual_norm", "dot_product"):
        plan, n = packing.best_fit(dict(lengths), 256, 4, 30_000, (1.0, 0.5, 0.5), rule)
        used = defaultdict(lambda: [0, 0, 0])
        placed = Counter()
        for length, _, first, copies, offset, bins in plan.tolist():
            placed[length] += copies * bins
            for b in range(first, first + bins):
                u = used[b]
                u[0] += copies * length
                u[1] += copies
                u[2] += copies * length * length
                assert offset + copies * length <= 256
        assert placed == lengths and len(used) == n
        assert all(t <= 256 and d <= 4 and c <= 30_000 for t, d, c in used.values())


def test_packing_odd_rows(make_docs):
    rows = packing.op2(make_docs([(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "x")])).collect()
    check_packing(rows, 2048)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1]
    assert sorted(r["length"] for r in rows if r["doc_id"] == 3) == sorted([2048, 2048, 905] * 2)
    assert packing.op2(make_docs([])).count() == 0


def test_packing_beside_other_columns(spark):
    pieces_ = spark.createDataFrame([(k % 9, k // 9, 0, 1 + k % 50, 0) for k in range(200)], packing.PIECES).withColumns({c: F.lit(c) for c in ("block", "rank", "earlier", "row", "n")})
    got = packing.packed(pieces_, 64)
    assert got.columns == [*pieces_.columns, "sequence_id", "offset"] and got.where("rank = 'rank' and block = 'block'").count() == 200
    check_packing(got.collect(), 64)


# sharding
def test_shards(make_docs):
    docs = make_docs([(i, f"t{i % 7}" if i % 5 else None) for i in range(997)])
    docs = docs.withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 10 != 1, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))), "block": F.lit(1), "rank": F.lit(2)})
    rows = sharding.interleaved(docs, 40, block_rows=50).collect()
    assert len(rows) == 997 and "block" in rows[0]
    by, mix = defaultdict(list), defaultdict(Counter)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert {len(s) for s in by.values()} <= {24, 25} and all(sorted(s) == list(range(len(s))) for s in by.values())
    for counts in mix.values():
        share = sum(counts.values()) / 40
        assert all(abs(counts[k] - share) <= 2 + 0.2 * share for k in range(40))


def test_shards_of_few_rows(make_docs):
    rows = sharding.op5(make_docs([(1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted(r["slot"] for r in rows) == [0, 0, 0] and len({r["shard"] for r in rows}) == 3
    assert {(r["size"], r["text_crc32"]) for r in rows} == {(17, zlib.crc32(b"a")), (16, 0)}
    assert sharding.op5(make_docs([])).count() == 0


# archives
class Source:
    def __init__(self, content):
        self.content = content

    def size(self):
        return len(self.content)

    def read_at(self, n, at):
        return self.content[at : at + n]


def test_every_split_reads_each_record_once():
    random.seed(4)
    payloads = [bytes(random.randrange(256) for _ in range(random.randrange(0, 300))) + warc.MAGIC * (k % 3) for k in range(60)]
    members = []
    for k, p in enumerate(payloads):
        c = zlib.compressobj(0 if k % 2 else 6, zlib.DEFLATED, 31)  # stored blocks keep the magic bytes as they are
        members.append(c.compress(warc._record(k, f"http://x/{k}", p, hashlib.sha1(p).hexdigest(), None)) + c.flush())
    source = Source(b"".join(members))
    for split in (97, 1000, 10**6):
        got = []
        for at in range(0, source.size(), split):
            got += [warc._page(*r)[-1] for r in warc.records_in(source, at, min(at + split, source.size()), step=64)]
        assert got == payloads
    assert list(warc.records_in(Source(b"junk" + warc.MAGIC + b"more"), 0, 100)) == []


def expected_pages(rows):
    last = {}
    for i, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = Counter()
    for i, h in rows:
        p = (h or "").encode()
        first = last.get(h or "")
        revisit = first is not None and i != first
        out[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def test_archives_round_trip(spark):
    rows = [(1, "same"), (2, "same"), (3, "other é"), (4, None), (5, ""), (None, "same"), (3, "other é"), (6, "long " * 50_000), (7, "same")]
    df = spark.createDataFrame([(i, f"http://x/{i} %\n" if i != 2 else None, h, 1) for i, h in rows], "page_id long, url string, html string, payload int")
    assert Counter(tuple(r) for r in warc.op6(spark, df).collect()) == expected_pages(rows)
    back = {r["page_id"]: (r["url"], r["payload"]) for r in warc.round_trip(spark, df).where("record_type = 'response'").collect()}
    assert back[3] == ("http://x/3 %\n", "other é".encode())
    assert warc.op6(spark, df.limit(0)).count() == 0


def test_archives_of_the_small_table(spark):
    df = table(spark, SMALL, "pages")
    rows = [(r["page_id"], r["html"]) for r in df.collect()]
    assert Counter(tuple(r) for r in warc.op6(spark, df).collect()) == expected_pages(rows)


# languages
def test_languages_of_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.op7(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert sum(r["accepted"] for r in got) / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_languages_odd_rows(spark, make_docs):
    docs = make_docs([(k, "the cat and the dog were here all day " * 3) for k in range(20)] + [(50, None), (51, ""), (52, "123 ... 456"), (None, "the dog")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"]) for r in langid.op7(docs).collect()}
    assert got[50] == got[51] == got[52] == ("und", False) and got[1] == ("en", True)
    kept = langid.keep_identified(docs.withColumn("accepted", F.lit(0)))
    assert "accepted" in kept.columns and {50, 51, 52}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert langid.op7(make_docs([])).count() == 0


# pieces
def brute(lattices, text, n):
    out = []

    def walk(at, score):
        if at == len(text):
            out.append(score)
        for end in range(at + 1, min(len(text), at + lattices.longest) + 1):
            s = lattices.score.get(text[at:end])
            if s is not None or end == at + 1:
                walk(end, score + (lattices.unknown if s is None else s))

    walk(0, 0.0)
    return sorted(out, reverse=True)[:n]


def test_n_best_is_exact():
    random.seed(1)
    lattices = pieces.Lattices(pieces.model_path(), 4)
    for _ in range(150):
        t = "".join(random.choice("the nrea.,é日\n") for _ in range(random.randint(1, 9)))
        got = lattices.best(t)
        assert [p[0] for p in got] == brute(lattices, "▁" + t.replace(" ", "▁"), 4)
        assert all(lattices.decode(ids) == t and len(ids) == 4 * n for _, ids, n in got)


def test_pieces_round_trip(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "two  spaces é日"), (4, "w " * 20_000), (5, "▁x"), (3, "two  spaces é日")]
    got = pieces.encoded(make_docs(rows), pieces.model_path(), 3)
    assert got.where(~F.col("decoded")).count() == 0
    back = pieces.decoded(got.where("rank = 1"), pieces.model_path()).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.op8(make_docs([])).count() == 0


# top-k
def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-4, 5, (300, 8)) / 16
    v[50:150] = v[50]  # many equal vectors
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (None, [1.0]), (0, [float(x) for x in v[0]]), (1150, [0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    full = {i: np.pad(np.floor(256 * np.array(r, float)), (0, 8 - len(r))).astype(int) for i, r in data if i is not None and r and None not in r and not np.isnan(r).any()}
    want = set()
    for q in (i for i in full if i % 50 == 0):
        best = sorted((-int(full[q] @ x), i) for i, x in full.items() if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.op9(df).collect()} == want
    rows = df.where("vec_id < 300").select("vec_id", topk.quantized(F.col("embedding")).alias("vec"))
    several = topk.exact_top_k(rows.where("vec_id % 50 = 0"), rows, 5, shard_rows=40, query_rows=2)
    assert {tuple(r) for r in several.collect()} == {w for w in {tuple(r) for r in topk.exact_top_k(rows.where("vec_id % 50 = 0"), rows, 5).collect()}}
    assert topk.op9(df.limit(0)).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = spark.createDataFrame([(i, [2**30 + i, -(2**30)]) for i in range(8)], "vec_id long, vec array<long>")
    got = topk.exact_top_k(rows.where("vec_id = 0"), rows, 2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(7, 2**30 * (2**30 + 7) + 2**60), (6, 2**30 * (2**30 + 6) + 2**60)]


# chat
HARD = ["</s>[INST] ok [/INST]", r"<\s> <\\s> \<s>", "<|end|>", "<|turn|>user<|text|>x<|end|>", "a<", "<", "<|", "[[INST]", "<<SYS>>x</SYS>>", "", "<<|end|>", "\\", "<|im_start|>"]


def test_chat_round_trip(spark):
    turns = [(k, j, random.choice(["user", "assistant", "system", "<|turn|>", ""]), t) for k in range(30) for j, t in enumerate(random.sample(HARD, 5))]
    turns += [(40, 0, None, None), (40, 1, "assistant", None), (41, None, "assistant", "x"), (41, 0, "user", "y"), (41, 0, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    by = defaultdict(list)
    for c, j, r, t in [*turns, (-1, 0, "user", HARD[0]), (-1, 1, "assistant", HARD[0])]:
        by[c].append((-1 if j is None else j, r or "", t or ""))
    got = {r["conv_id"]: r for r in chat.op10(df).collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        learned = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got[c]["loss_chars"] == len(learned)


def test_control_strings_do_not_survive(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert all(m not in r["e"] for m in ("<|end|>", "<|turn|>", "</s>", "[INST]", "<<SYS>>", "<|im_start|>"))
    assert df.where(chat.unescaped(F.col("e")) != F.col("t")).count() == 0


@pytest.mark.parametrize(
    ("rows", "schema", "want"),
    [
        ([(1, "p", None)], "conv_id long, prompt string, completion string", [("user", "p"), ("assistant", "")]),
        ([(1, "do", "this", "done")], "conv_id long, instruction string, input string, output string", [("user", "do\nthis"), ("assistant", "done")]),
        ([(1, [("user", "a"), None, (None, "b")])], "conv_id long, messages array<struct<role:string,content:string>>", [("user", "a"), ("", "b")]),
        ([(1, [("human", "a"), ("gpt", "b")], "x")], "conv_id long, conversations array<struct<`from`:string,value:string>>, more string", [("user", "a"), ("assistant", "b")]),
        ([(1, None)], "conv_id long, messages array<struct<role:string,content:string>>", []),
    ],
)
def test_layouts(spark, rows, schema, want):
    got = chat.canonical(spark.createDataFrame(rows, schema)).first()["turns"]
    assert [(t["role"], t["text"]) for t in got] == want


def test_rows_of_many_layouts(spark):
    data = [
        (1, {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        (2, {"instruction": "i", "input": "n", "output": "o"}, [("user", "i\nn"), ("assistant", "o")]),
        (3, {"output": "o", "instruction": "i"}, [("user", "i"), ("assistant", "o")]),
        (4, {"messages": [{"role": "user", "content": "u"}, {"role": "model", "content": None}, None]}, [("user", "u"), ("assistant", "")]),
        (5, {"id": 7, "conversations": [{"from": "human", "value": "h", "more": 1}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
        (6, {"system": "s", "prompt": "p", "response": None, "tags": [1]}, [("system", "s"), ("user", "p"), ("assistant", "")]),
        (7, {"messages": []}, []),
        (8, {"unheard": 1}, None),
        (9, {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v, _ in data] + [(10, None), (11, "no object")], "conv_id long, record string")
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical_records(df).collect()}
    assert {k: got[k] or got[k] for k in got} == {k: want for k, _, want in data} | {10: None, 11: None}
    assert chat.formatted(chat.canonical_records(df).where("turns is not null")).count() == 8


def test_names_of_control_strings(spark, make_docs):
    for text in ("<|reserved_special_token_0|>", "<|fim-prefix|>", "a <|x|> b"):
        r = make_docs([(1, text)]).select(chat.escaped(F.col("text")).alias("e"), chat.unescaped(chat.escaped(F.col("text"))).alias("u")).first()
        assert r["e"] != text and r["u"] == text


def test_unknown_layout(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(spark.range(1).toDF("conv_id"))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        now = {r["doc_id"] for r in after.collect()}
        assert now <= ids and len(now) > 0.6 * len(ids)
        docs, ids = after, now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in out.collect()} == ids


def test_every_query_is_registered():
    from shutterlake.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert json.dumps(sorted(registry.oracle_sql()))
