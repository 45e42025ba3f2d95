"""Column names of every kind, the plans for large tables on small ones, and inputs that once crashed."""

import random
import struct
import time

import numpy as np
import pytest
from test_line_dedup import brute, result, sample
from test_near_dup import rand_text

from recordloom.llm import bpe, common, html_cut, licenses, line_dedup, media, mixing, near_dup, toxicity

ODD = ["a.b", "__m", "__key", "__id", "__drop", "__dup_id", "__lines", "c0", "c1", "id", "key", "n_lines", "n_dropped", "text2", "n_tokens", "tokens", "gone", "drop"]


def odd(spark, rows):
    data = [(i, t, "en", f"s{i % 3}" if i is not None else "s", len(t or ""), *range(len(ODD))) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in ODD))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(1)
    texts = [rand_text(rng, 60) + f"\nline {i % 4}\n" + rand_text(rng, 20) for i in range(40)]
    return odd(spark, [*enumerate(texts), (40, texts[0]), (40, texts[0]), (None, texts[1]), (41, None)])


def test_stages_keep_any_column(spark, odd_docs):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    for out in (toxicity.stage(odd_docs, toxicity.train(odd_docs, labels)), line_dedup.stage(odd_docs), near_dup.keep_one(odd_docs), mixing.stage(odd_docs, mixing.plan(odd_docs))):
        assert out.columns == odd_docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == tuple(range(len(ODD))) for r in rows)


def test_dedup_and_codec_with_clashing_names(spark, odd_docs):
    got = line_dedup.dedup_lines(odd_docs, lines_col="lines of it", dropped_col="x.y")
    assert got.columns == [*odd_docs.columns, "lines of it", "x.y"] and got.count() == 44
    coded = bpe.encode(odd_docs, keep=("doc_id", "tokens", "a.b"))
    assert coded.columns == ["doc_id", "tokens", "a.b", "n_tokens", "tokens", "round_trip"] and coded.count() == 44
    assert media.media_columns(odd_docs.selectExpr("doc_id", "`a.b`", "cast(null as binary) content"), keep=("doc_id", "a.b")).columns[:2] == ["doc_id", "a.b"]


@pytest.mark.parametrize("kw", [{"small": 0}, {"max_bits": 2000}, {"small": 0, "max_bits": 2000}])
def test_line_dedup_plans_agree(spark, kw):
    rows = sample(200, 7) + [(1000 + i, "the same line in each\n" * 3 + str(i)) for i in range(300)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **kw) == brute(rows)


def test_parted_never_misses(spark):
    df = spark.range(3000).selectExpr("id as a", "cast(null as int) b").unionByName(spark.sql("select cast(null as bigint) a, 1 b"))
    ids = spark.range(0, 3000, 7).selectExpr("id")
    rest, hit = common.parted(df, 0, ids, 429)
    a, b = [r.a for r in rest.collect()], [r.a for r in hit.collect()]
    assert set(range(0, 3000, 7)) <= set(b) and None in a and sorted(x for x in a + b if x is not None) == list(range(3000)) and len(b) < 1000


def test_hot_keys_give_the_same_groups(spark):
    rng = random.Random(4)
    shared, rows = rand_text(rng, 80).split(), []
    for i in range(60):
        w = list(shared)
        for j in rng.sample(range(80), i % 12):
            w[j] = f"q{i % 5}{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rand_text(rng, 80)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain, hot = (sorted(map(tuple, near_dup.near_duplicates(df, hot=h).select("doc_id", "group_id").collect())) for h in (near_dup.HOT, 3))
    assert plain == hot and len(plain) > 40
    assert {r.doc_id for r in near_dup.keep_one(df, small=0).collect()} == {r.doc_id for r in near_dup.keep_one(df).collect()}


def test_runs_stay_together():
    import pyarrow as pa

    keys = sorted(random.Random(2).choices(range(30), k=500))
    cut = [0, 3, 3, 90, 91, 300, 500]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64())], names=["k"]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    parts = [t.column(0).to_pylist() for t in near_dup._runs(batches)]
    assert sum(parts, []) == keys and all(a[-1] != b[0] for a, b in zip(parts[:-1], parts[1:], strict=True))


def full(kind, *x, version=0, flags=0):
    return media.box(kind, struct.pack(">I", version << 24 | flags), *x)


def track(number, scale, duration, tables, codec=b"mp4a", handler=b"soun", wide=False):
    mdhd = full(b"mdhd", struct.pack(">QQIQI", 0, 0, scale, duration, 0) if wide else struct.pack(">IIIII", 0, 0, scale, duration, 0), version=int(wide))
    stsd = full(b"stsd", struct.pack(">I", 1), media.box(codec, b"\0" * 28))
    mdia = media.box(b"mdia", mdhd, full(b"hdlr", b"\0\0\0\0" + handler + b"\0" * 13), media.box(b"minf", full(b"smhd", b"\0" * 4), media.box(b"dinf", full(b"dref", b"\0" * 4)), media.box(b"stbl", stsd, *tables)))
    edts = media.box(b"edts", full(b"elst", struct.pack(">IIIHH", 1, duration & 0xFFFFFFFF, 0, 1, 0)))
    return media.box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0) + b"\0" * 60), edts, mdia)


def test_two_tracks_edit_lists_offsets_of_64_bits_and_composition_times():
    video = [full(b"stts", struct.pack(">III", 1, 4, 512)), full(b"ctts", struct.pack(">IIi", 1, 4, 1024)), full(b"stss", struct.pack(">II", 1, 3)), full(b"stsz", struct.pack(">II4I", 0, 4, 10, 20, 30, 40)), full(b"stsc", struct.pack(">I6I", 2, 1, 3, 1, 2, 1, 1)), full(b"co64", struct.pack(">I2Q", 2, 1 << 33, 5000))]
    audio = [full(b"stts", struct.pack(">III", 1, 3, 1024)), full(b"stsz", struct.pack(">II", 4, 3)), full(b"stsc", struct.pack(">I3I", 1, 1, 1, 1)), full(b"stco", struct.pack(">I3I", 3, 100, 200, 300))]
    got = media.read(media.box(b"ftyp", b"qt  \0\0\0\0") + media.box(b"free", b"x" * 9) + media.box(b"moov", track(1, 12800, 2048, video, b"hvc1", b"vide"), track(2, 48000, 3072, audio)))
    v, a = got["tracks"]
    assert got["error"] is None and got["brand"] == "qt  " and got["duration_s"] == max(2048 / 12800, 3072 / 48000)
    assert (v["codec"], v["n_samples"], v["keyframes"]) == ("hvc1", 4, [{"start": (1 << 33) + 30, "size": 30}])
    assert (a["codec"], a["handler"], a["keyframes"]) == ("mp4a", "soun", [{"start": s, "size": 4} for s in (100, 200, 300)])


def test_fragments_with_defaults():
    moov = media.box(b"moov", track(7, 1000, 0, [full(x, b"\0" * 4) for x in (b"stts", b"stsc", b"stco")] + [full(b"stsz", b"\0" * 8)]), media.box(b"mvex", full(b"trex", struct.pack(">IIIII", 7, 1, 40, 6, 0x10000))))
    moof = media.box(b"moof", full(b"mfhd", b"\0" * 4), media.box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"tfdt", struct.pack(">Q", 0), version=1), full(b"trun", struct.pack(">IiI", 3, 64, 0), flags=5)))
    t = media.read(moov + moof)["tracks"][0]
    assert (t["n_samples"], t["duration"], t["bytes"], t["keyframes"]) == (3, 120, 18, [{"start": len(moov) + 64, "size": 6}])


def test_hostile_media(spark):
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    unknown = media.box(b"moov", track(1, 1000, (1 << 64) - 1, [], wide=True))
    huge = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)))))))
    chunks = media.box(b"moov", track(1, 1000, 0xFFFFFFFF, [full(b"stsz", struct.pack(">II", 3, 5)), full(b"stsc", struct.pack(">I3I", 1, 1, 0xFFFFFFFF, 1)), full(b"stco", struct.pack(">II", 1, 9))]))
    trun = media.box(b"moov", track(1, 1, 1, [])) + media.box(b"moof", media.box(b"traf", full(b"tfhd", struct.pack(">I", 1)), full(b"trun", struct.pack(">I", 0xFFFFFFFF))))
    df = spark.createDataFrame([(i, x) for i, x in enumerate((deep, unknown, huge, chunks, trun))], "doc_id long, content binary")
    got = {r.doc_id: r for r in media.media_columns(df).collect()}
    assert got[0].error == "too deep" and got[1].error is None and got[1].tracks[0].duration is None and got[1].duration_s is None
    assert got[2].error == "impossible count" and [(k.start, k.size) for k in got[3].tracks[0].keyframes] == [(9 + 3 * i, 3) for i in range(5)]
    assert got[3].tracks[0].duration is None and got[4].error == "impossible count"


def test_runs_of_spoilt_notices_are_linear(spark):
    took = []
    for n in (500, 4000):
        df = spark.createDataFrame([(1, "Released undr the MIT License. " * n)], "doc_id long, text string")
        began = time.time()
        assert licenses.notices(df).where("license = 'MIT' and edits = 1").count() == n
        took.append(time.time() - began)
    assert took[1] < 10


def test_cut_moves_blocks_of_a_page_without_semantic_tags(spark):
    rng = random.Random(5)
    say = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(k)).capitalize() + "."
    link = lambda: f'<li><a href="/x">{say(1)[:-1]}</a></li>'
    whole = lambda n: f"<html><body><nav><ul>{''.join(link() for _ in range(7))}</ul></nav><article><h1>{say(6)}</h1>{''.join(f'<p>{say(rng.randrange(8, 60))}</p>' for _ in range(n))}</article><footer>{say(2)} {say(3)}</footer></body></html>"
    w = html_cut.train(spark.createDataFrame([(i, whole(rng.randrange(2, 12))) for i in range(150)], "page_id long, html string"))
    body = [say(50), say(45), "No", say(60), say(40)]
    menu = "".join(f"<div><a href=/{i}>{say(1)[:-1]}</a></div>" for i in range(6))
    page = f"<body><div id=x>{menu}</div><div id=y>" + "".join(f"<div>{b}</div>" for b in body) + "</div></body>"
    got = html_cut.extract(spark.createDataFrame([(1, page)], "page_id long, html string"), w).first()
    assert got.text.split("\n") == body and got.n_moved >= 1


SF = "/root/testdata/sf0.01"


def test_mixture_cuts_keeps_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = mixing.mixture(docs, mixing.plan(docs)).collect()
    copies = {r.doc_id: 0 for r in docs.where("octet_length(text) > 0").collect()}
    tokens = {}
    for r in got:
        copies[r.doc_id] += r.copies
        tokens[r.bucket] = tokens.get(r.bucket, 0) + r.copies * r.tokens
    assert {0, 1, 2} <= set(copies.values())
    found = {}
    for r in docs.collect():
        m = tuple(sorted((f"source:{r.source}", f"lang:{r.lang}")))
        found[m] = found.get(m, 0) + (len(r.text.encode()) + 3) // 4
    quota = mixing.quotas(sorted(found.items()), None, mixing.BUDGET, mixing.TEMPERATURE, mixing.FAMILIES)
    for k in (x for x in quota if x.startswith("lang:")):
        assert tokens[k] == pytest.approx(quota[k], rel=0.01, abs=8000)  # whole documents, of up to 30,000 tokens


def test_gradient_of_the_loss():
    rng = np.random.default_rng(1)
    row, col, val = rng.integers(0, 12, 60), rng.integers(0, 7, 60), rng.normal(size=60)
    f = toxicity.loss(row, col, val, 7, rng.integers(0, 4, 12), 0.01)
    p = rng.normal(size=toxicity.GRADES + 7) * 0.5
    for i in range(p.size):
        e = np.zeros_like(p)
        e[i] = 1e-6
        assert f(p)[1][i] == pytest.approx((f(p + e)[0] - f(p - e)[0]) / 2e-6, abs=1e-6)


def test_grades_and_markers_like_plain_python():
    rng = random.Random(2)
    toxic = np.array([rng.random() < 0.3 for _ in range(300)])
    texts = [" ".join([f"w{rng.randrange(80)}" for _ in range(30)] + (["vile"] * rng.randrange(0, 9) if t else ["vile"] * (rng.random() < 0.02))) for t in toxic]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    idx, counts, bounds = toxicity.counted(data, off)
    bad, good = (lambda w, x: sum(w in t.split() for t, y in zip(texts, toxic, strict=True) if y == x)), None
    n1, n0 = toxic.sum(), (~toxic).sum()
    marked = {w for w in {w for t in texts for w in t.split()} if bad(w, True) >= max(3, 0.02 * n1) and bad(w, True) / n1 > 8 * (bad(w, False) + 0.5) / n0}
    share = np.array([sum(w in marked for w in t.split()) / len(t.split()) for t in texts])
    cuts = np.quantile(share[toxic & (share > 0)], [1 / 3, 2 / 3])
    want = [0 if not t else 1 + (s >= cuts[0]) + (s >= cuts[1]) for t, s in zip(toxic, share, strict=True)]
    assert toxicity.grades(idx, counts, bounds, toxic).tolist() == want and marked == {"vile"} and good is None


def test_round_trip_is_told_by_row_and_nothing_decodes_to_nothing(spark):
    assert bpe.decode(spark.createDataFrame([], "doc_id long, tokens array<int>")).count() == 0
    got = bpe.encode(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert all(r.round_trip for r in got)


def test_settings_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(64 << 20))
    try:
        common.small_batches(spark)
        assert spark.conf.get(name) == str(64 << 20)
    finally:
        spark.conf.unset(name)
    common.small_batches(spark)
    assert spark.conf.get(name) == str(4 << 20)
