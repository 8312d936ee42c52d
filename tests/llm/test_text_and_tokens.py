"""Words and shingles, cached tokenizers, packing, token shards, chat formatting."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import chat, packing, tokenstore
from gridloom.llm.storage import fresh_path
from gridloom.llm.textops import WordCache, as_strings, ngrams, shingle_sets, slices, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "A b\tC\n\rd", "x" * 300_000, "ü Ü ß   y", "a  b", " lead", "trail ", "don't we'll I'M", "</s> <|endoftext|>", "日本 語　字", "ΟΔΟΣ ς", "a\x1cb \x1c", "é ̈x", "1 22 ½ …. a….", "| a| |b|", "\n\n", "a\n\nb", "word. word, (word) 'word' -- !"]
text = st.text(alphabet=st.sampled_from(list("aAbB .,'!|\n\t0é—ΣİÄ ̈ x"))).map(lambda s: s[:60])


def brute_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_words_and_shingles():
    col = as_strings(pa.array([*ODD, None]))
    h, n = words(col)
    assert n.tolist() == [len(brute_words(t)) for t in [*ODD, None]]
    seen = {}
    for a, b in zip(h.tolist(), [w for t in [*ODD, None] for w in brute_words(t)], strict=True):
        assert seen.setdefault(b, a) == a
    assert len(set(seen.values())) == len(seen)
    long = "The quick brown fox jumps over the quick brown fox jumps over it"
    w = brute_words(long)
    assert len(next(shingle_sets(as_strings(pa.array([long]))))) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert [len(s) for s in shingle_sets(as_strings(pa.array(["a b", "A  b", "", None, "a b c"])))] == [1, 1, 0, 0, 1]
    two = list(shingle_sets(as_strings(pa.array(["a b", "A\tB"]))))
    assert two[0].tolist() == two[1].tolist()
    g, c = ngrams(h, n, 3)
    assert c.tolist() == [max(0, k - 2) for k in n.tolist()] and len(g) == c.sum()
    cuts = list(slices(col, 10))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(col) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))


@pytest.fixture(scope="module")
def caches():
    out = {}
    for path, spaced in ((BYTE, True), (WORD, False)):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        out[path] = (WordCache(path, spaced, most=50), t)
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cache_gives_the_librarys_ids(caches, path):
    cache, t = caches[path]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(text, max_size=4))
    def check(texts):
        ids, n = cache.encode(texts)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]

    check()
    for x in ODD:
        assert cache.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_balance_fills_sequences():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 129, 500).tolist()
    plans = packing.balance(lengths, 128)
    assert len(plans) == -(-sum(lengths) // 128) and all(sum(n for *_, n in p) == 128 for p in plans[:-1])
    got = sorted((d, a, n) for p in plans for d, a, n in p)
    for d, n in enumerate(lengths):
        own = [(a, k) for x, a, k in got if x == d]
        assert sum(k for _, k in own) == n and all(a == sum(k for _, k in own[:i]) for i, (a, _) in enumerate(own))
    assert packing.balance([], 128) == [] and packing.powers(13) == [8, 4, 1]


def test_balance_takes_the_cheapest_with_room():
    rng = np.random.default_rng(3)
    for width, high in ((64, 65), (64, 40), (64, 9)):
        lengths = rng.integers(1, high, 200).tolist()
        plans = packing.balance(lengths, width)
        room = [width] * len(plans)
        room[-1] = sum(lengths) - width * (len(plans) - 1)
        spent = [0.0] * len(plans)
        whole = {d: s for s, p in enumerate(plans) for d, a, n in p if n == lengths[d]}
        cut = {d for p in plans for d, a, n in p} - set(whole)
        for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [s for s in range(len(plans)) if room[s] >= lengths[d]]
            if not fit:  # cut, or by luck whole in what is left
                continue
            assert d not in cut and whole[d] == min(fit, key=lambda s: spent[s])
            room[whole[d]] -= lengths[d]
            spent[whole[d]] += packing.cost(lengths[d], 1.0, width)


def test_packing_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma.", "d"], rng.integers(0, 900))) for _ in range(60)] + [None, "", "z" * 30_000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    out = packing.pack_documents(docs, BYTE, width=256, buffer_sequences=16).toPandas()
    t = Tokenizer.from_file(BYTE)
    for doc, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32)
        own = out[out.doc_id == doc].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        size = s.length.sum()
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and size <= 256 and (size == 256 or size & (size - 1) == 0)
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_token_shards(spark):
    texts = ["hello world", None, "", "Naïve CAFÉ " * 50, "x" * 100_000, "dup", "dup"]
    ids = [5, 3, None, -7, 40, 8, 8]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    path = fresh_path(spark, "test-tokens")
    manifest = tokenstore.write_tokens(docs, path, WORD, False, 2, partitions=2, shard_bytes=200)
    got = tokenstore.read_tokens(manifest, path).toPandas().sort_values("start")
    t = Tokenizer.from_file(WORD)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
    want = [np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], np.uint32) for i in order]
    assert [None if x != x else int(x) for x in got.doc_id.tolist()] == [ids[i] for i in order]
    assert got.n_tokens.tolist() == list(map(len, want)) and got.ids_crc32.tolist() == [zlib.crc32(w.tobytes()) for w in want]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(list(map(len, want)))[:-1]]).tolist()
    local = path.removeprefix("file://")
    dictionary = open(f"{local}/dictionary.zstd", "rb").read()
    for r in manifest.collect():
        shard = tokenstore.ShardReader(r.path, dictionary)
        for k in range(len(shard)):
            if not shard.null[k]:
                first = next(i for i in range(len(shard)) if not shard.null[i] and shard.doc[i] == shard.doc[k])
                assert len(shard.find(int(shard.doc[k]))) == shard.size[first]
        assert shard.find(123456) is None
        with pytest.raises(ValueError, match="another dictionary"):
            tokenstore.ShardReader(r.path, dictionary + b"x")
    assert tokenstore.roundtrip(spark, docs.limit(0), WORD, False, 2).count() == 0


control = st.lists(st.sampled_from(["<", "/", "s", ">", "[", "INST]", "|", "\\", "a", "</s>", "<s>", "[/INST]", "<|end|>", "\n"]), max_size=12).map("".join)


def test_chat_texts_come_back(spark):
    rows = []

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys</s>tem", None, "ro|>le", "a|", "b<", "|\\>[INST]", "<|>", "|", "\\|>\\"]), control), min_size=1, max_size=4))
    def collect(turns):
        rows.extend((len(rows) // 4, i, r, t) for i, (r, t) in enumerate(turns))

    collect()
    rows = [(i // 3, i, r, t) for i, (_, _, r, t) in enumerate(rows)]
    rows += [(None, None, "assistant", None), (-5, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    for r in chat.parse_chats(made).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss_text == "".join(x[3] or "" for x in own if x[2] == "assistant")
        body = r.formatted[len("<s>") : -len("</s>")]
        assert "</s>" not in body and "[INST]" not in body and "[/INST]" not in body
        assert body.count("<|end|>") == len(own) == r.n_turns
    assert chat.format_chats(df.limit(0).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0


def part(**k):
    return {**dict.fromkeys(["type", "text", "ref", "width", "height", "seconds", "pages"]), **k}


def test_chat_of_any_split_formats_as_the_whole(spark):
    rng = np.random.default_rng(5)
    pieces = ["<", "/", "s", ">", "[", "INST]", "|", "\\", "a", "end", "turn:", "assistant", "image:0"]
    texts = ["<|end|><|turn:assistant|>evil", "</s>", "[/INST]", "<\\\\|image:0|>", *("".join(rng.choice(pieces, 12)) for _ in range(80))]
    rows = []
    for i, x in enumerate(texts):
        rows.append((i, 0, "user", [part(type="text", text=x)]))
        for k in range(1, 4):
            cuts = sorted(rng.integers(0, len(x) + 1, k).tolist())
            rows.append((i + 1000 * k, 0, "user", [part(type=["text", "odd", None][n % 3], text=x[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)], strict=True))]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    for i, x in enumerate(texts):
        assert len({got[i + 1000 * k].formatted for k in range(4)}) == 1
        assert [(t.role, t.text) for t in got[i].turns] == [("user", x)]


def brute_visit(messages):
    """(text of each message, attachments) by walking the parts."""
    out, found = [], []
    for parts in messages:
        text, run = "", ""
        for p in [*(parts or []), None]:
            if p is None or p["type"] in ("image", "audio", "document"):
                text += re.sub(r"(<\\*)(?=/?s>|\|)|(\[\\*)(?=/?INST\])", lambda m: m[0] + "\\", run)
                run = ""
                if p is not None:
                    text += f"<|{p['type']}:{len(found)}|>"
                    n = {"image": lambda: max(1, -(-(p["width"] or 1) // 336)) * max(1, -(-(p["height"] or 1) // 336)) * 144 + 1, "audio": lambda: -(-(p["seconds"] or 0) * 25 // 1), "document": lambda: max(1, p["pages"] or 1) * 512}[p["type"]]()
                    found.append((len(found), p["type"], p["ref"], int(n)))
            else:
                run += p["text"] or ""
        out.append(text)
    return out, found


def test_chat_of_mixed_parts_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for conv in range(40):
        for turn in range(int(rng.integers(1, 6))):
            parts = []
            for _ in range(int(rng.integers(0, 6))):
                kind = str(rng.choice(["text", "text", "image", "audio", "document", "video"]))
                parts.append(part(type=kind, text=str(rng.choice(["<", "|end|>", "see ", "</s", ">", "[", "INST]"])), ref=f"r{rng.integers(9)}", width=int(rng.integers(0, 900)), height=None, seconds=float(rng.integers(0, 9)) / 4, pages=int(rng.integers(0, 4))))
            rows.append((conv, turn, str(rng.choice(["user", "assistant"])), parts if rng.integers(9) else None, 1, "x"))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, place int, formatted string")
    got = chat.parse_chats(chat.format_chats(df)).collect()
    assert len(got) == 40
    for r in got:
        own = [x for x in rows if x[0] == r.conv_id]
        texts, found = brute_visit([x[3] for x in own])
        assert r.formatted == "<s>" + "".join(f"<|turn:{x[2]}|>{t}<|end|>" for x, t in zip(own, texts, strict=True)) + "</s>"
        assert [tuple(a) for a in r.attachments] == found and r.expanded_tokens == sum(f[3] for f in found) and r.n_turns == len(own)
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [t for x, t in zip(own, texts, strict=True) if x[2] == "assistant"]


def test_chat_attachments(spark):
    p = part
    rows = [(1, 0, "user", [p(type="text", text="see <|image:0|> "), p(type="image", ref="a.png", width=400, height=300), p(type="audio", ref="b.wav", seconds=2.0)]),
            (1, 1, "assistant", [p(type="text", text="ok"), p(type="document", ref="c.pdf", pages=3), p(type="mystery", text="!")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.parse_chats(chat.format_chats(df)).first()
    assert r.turns[0].text == "see <|image:0|> <|image:0|><|audio:1|>" and r.turns[1].text == "ok<|document:2|>!"
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 2 * 144 + 1), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1536)]
    assert r.formatted.count("<|image:0|>") == 1 and r.expanded_tokens == 289 + 50 + 1536


def test_tasks_that_do_not_tokenize_drop_word_caches():
    """What packing leaves in a Python worker isn't held while the next run's first stage works in it."""
    import numpy as np
    import pyarrow as pa

    from gridloom.llm import importance, textops

    class Docs:
        """Gives the function of the tasks."""

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            return f

    Docs.schema = [type("Field", (), {"name": "doc_id", "dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})]
    textops._CACHES["left", True, 1] = None
    task = importance.weigh(Docs(), np.zeros(importance.BUCKETS))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"])], names=["doc_id", "text"])
    assert [b.to_pylist() for b in task(iter([batch]))] == [[{"doc_id": 1, "log_weight": 0.0, "n_grams": 3}]]
    assert not textops._CACHES
