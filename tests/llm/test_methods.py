"""What the methods find beyond their base rules, and the pipeline."""

import base64
import json
import random
from collections import Counter

import pytest

from driftline.llm import decontaminate, secrets

from . import brute
from .conftest import prose, vocabulary


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n, "big")
    return bytes([tag]) + head + body


RSA = der(0x30, der(0x02, b"\0") + b"".join(der(0x02, random.Random(k).randbytes(40)) for k in range(1, 5)))
EC = der(0x30, der(0x02, b"\x01") + der(0x04, bytes(range(32))) + der(0xA0, der(0x06, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
url64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
JWT = ".".join([url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(json.dumps({"sub": "1"}).encode()), url64(bytes(range(32)))])
field = lambda x: len(x).to_bytes(4, "big") + x
PUBLIC = b"".join(map(field, (b"ssh-ed25519", bytes(range(32)))))
FRAME = b"openssh-key-v1\0" + b"".join(map(field, (b"none", b"none", b""))) + (1).to_bytes(4, "big") + field(PUBLIC) + field(bytes(range(136)))
SSH = base64.b64encode(FRAME).decode()
WRAPPED = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(0x05, b"")) + der(0x04, RSA))
BARE = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2b\x65\x70")) + der(0x04, der(0x04, bytes(range(32)))))
LOCKED = der(0x30, der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x30, der(0x04, bytes(8)) + der(0x02, b"\x08\x00"))) + der(0x04, bytes(range(64))))
OPEN_KEY = der(0x30, der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b"")) + der(0x03, b"\0" + der(0x30, der(0x02, bytes([1] * 64)) + der(0x02, b"\1\0\1"))))
b64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"x {base64.b64encode(RSA).decode()} y", "der"),
        (f"x {EC.hex().upper()} y", "der"),
        (f"Bearer {JWT}", "jwt"),
        (f"key {SSH} me", "ssh"),
        (f"x {b64(WRAPPED)} y", "der"),
        (f"x {b64(BARE)} y", "der"),
        (f"x {LOCKED.hex()} y", "der"),
        ("-----BEGIN OPENSSH PRIVATE KEY-----\n" + base64.encodebytes(FRAME).decode() + "-----END OPENSSH PRIVATE KEY-----", "pem"),
        ("é -----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----", "pem"),
    ],
)
def test_structure_confirms(text, kind):
    spans = [s for s in secrets.find(text) if s[0] == kind]
    assert len(spans) == 1 and text[spans[0][1] : spans[0][2]] in text


@pytest.mark.parametrize(
    "text",
    [
        base64.b64encode(RSA[:-1]).decode(),
        base64.b64encode(b"plain prose that is long enough to be a candidate run").decode(),
        "A" * 64,
        JWT.replace(JWT.split(".")[0], url64(b'{"typ": "JWT", "pad": "xxxxxxxxx"}')),
        "word" * 20,
        "-----BEGIN RSA PRIVATE KEY-----\nnot a key\n-----END RSA PRIVATE KEY-----",
        b64(WRAPPED.replace(b"\x02\x28", b"\x02\x27")),  # an inner length that doesn't fill what is around it
        b64(der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2b\x65\x70")) + der(0x04, b"junk that is no value at all....."))),
        b64(OPEN_KEY),
        f"ssh-ed25519 {b64(PUBLIC)} me",
        "-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(OPEN_KEY).decode() + "-----END CERTIFICATE-----",
        b64(b"openssh-key-v1\0 and then prose that goes on for long enough to be looked at"),
        b64(FRAME[:-8]),
    ],
)
def test_structure_denies(text):
    assert not [s for s in secrets.find(text) if s[0] not in ("assign", "access", "hex")]


def test_redaction(spark):
    rows = [(1, "a token = abcdefgh b", 20), (2, None, None), (3, "clean", 5), (4, f"x {JWT} y", None)]
    out = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()}
    assert out[1].text == "a [SECRET] b" and out[1].n_chars == 12
    assert out[2].text is None and out[2].n_chars is None and out[3].text == "clean" and out[4].text == "x [SECRET] y"


ITEM = "Alice bought 12 apples for 5 dollars, then gave Alice half of the 12 apples to her brother Bob before walking 3 miles home."


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(2)
    w = vocabulary(9)
    return spark.createDataFrame([(1, ITEM, "c"), (2, prose(rng, w, 40), "c"), (3, "too short", "c"), (4, None, "c"), (5, "one two three four five six", "c"), (None, "seven lonely words without any number here", "c")], "item_id bigint, text string, doc_id string")


def found(spark, benchmark, texts):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    return sorted((r.doc_id, r.item_id, r.n_slots) for r in decontaminate.links(docs, benchmark).collect())


def test_verbatim_and_changed_parameters(spark, benchmark):
    changed = ITEM.replace("Alice", "Carol").replace("12", "30").replace("5 dollars", "9 euros").replace("Bob", "Dave").replace("3 miles", "7 km")
    torn = changed.replace("30 apples to", "31 apples to")
    other = ITEM.replace("bought", "sold").replace("gave", "lent").replace("before", "after").replace("half", "some")
    texts = ["padding words here " + ITEM + " and more", "now " + changed, "now " + torn, "", None, other, ITEM.lower(), "x one two three four five six y", "seven lonely words without any number here"]
    got = found(spark, benchmark, texts)
    assert (0, 1, 0) in got and (6, 1, 0) in got and (7, 5, 0) in got and (8, None, 0) in got
    assert [g for g in got if g[:2] == (1, 1)] and all(g[2] for g in got if g[0] == 1)
    assert not [g for g in got if g[0] in (2, 3, 4, 5)]


def test_long_documents_are_read_whole(spark, benchmark):
    w = vocabulary(4)
    rng = random.Random(1)
    assert found(spark, benchmark, [prose(rng, w, 30_000) + " " + ITEM, prose(rng, w, 30_000)]) == [(0, 1, 0)]


NAMES = "Ann Bob Carol Mary Tom Zoë Ravi Ivan Olga Élan".split()


def question(rng, words):
    """A question with numbers, names and units, and one that asks the same with others."""
    n = rng.randint(14, 40)
    kinds = [rng.choice(["word"] * 7 + ["name", "number", "amount"]) for _ in range(n)]
    plain = [rng.choice(words) for _ in range(n)]
    who, count = [rng.randrange(5) for _ in range(n)], [rng.randint(2, 30) for _ in range(n)]

    def told(names, factor, unit):
        out = []
        for i, kind in enumerate(kinds):
            out.append({"word": plain[i], "name": names[who[i]], "number": str(count[i] * factor), "amount": f"{count[i] * factor} {unit}"}[kind])
            if i % 9 == 8:
                out[-1] += "."
        text = " ".join(out)
        return text[0].upper() + text[1:]

    first, second = rng.sample(NAMES, 5), rng.sample(NAMES, 5)
    second[0] = "Mary Ann Lee"  # a name may have several words
    return told(first, 1, "miles"), told(second, 7, "kg")


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    w = vocabulary(5, 60)
    pairs = [question(rng, w) for _ in range(12)]
    items = [(i, p[0]) for i, p in enumerate(pairs)] + [(90, None), (91, ""), (92, "one two three four five"), (93, "a b c d"), (94, "Ann Bob Tom Ann 5 miles 6 kg"), (0, pairs[0][0])]
    texts = [None, "", " \n", "one two three four five", "Ann Bob Tom Ann 5 miles 6 kg", "a\x1cb"]
    for i, (a, b) in enumerate(pairs):
        half = b.split()
        texts += [f"{prose(rng, w, 30)} {a} {prose(rng, w, 5)}", f"Said. {b}", a.lower(), " ".join(half[: len(half) // 2 + 2]), b.replace("7", "8", 1), a + "\n" + pairs[i - 1][1]]
        cut = a.split()
        cut.insert(len(cut) // 2, "indeed")
        texts.append(" ".join(cut))
    texts.append(prose(rng, w, 20_000) + " " + pairs[3][1])
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[6]), (5, texts[6]), (None, texts[7])]
    frame = spark.createDataFrame([(*d, "c", "c", "c") for d in docs], "doc_id bigint, text string, item_id string, rid string, h string").repartition(3)
    benchmark = spark.createDataFrame([(*i, "c") for i in items], "item_id bigint, text string, k string")
    got = sorted(map(str, ((r.doc_id, r.item_id, r.start_word, r.end_word, r.item_start, round(r.share, 9), r.n_slots) for r in decontaminate.links(frame, benchmark).collect())))
    want = []
    for d, t in docs:
        for k, item in items:
            want += [(d, k, s, e, at, round(n / len(item.split()), 9), slots) for s, e, at, n, slots in brute.passages(t, item)]
    assert got == sorted(map(str, want)) and len(got) > 60
    kept = decontaminate.clean(frame, benchmark)
    bad = {t for d, t in docs for _, item in items if brute.passages(t, item)}
    assert kept.columns == frame.columns and sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for _, t in docs if t not in bad)


def test_reparameterised_questions_are_found(spark):
    rng = random.Random(3)
    w = vocabulary(8, 300)
    pairs = [question(rng, w) for _ in range(150)]
    docs = spark.createDataFrame([(i, f"{prose(rng, w, 60)}. {b} {prose(rng, w, 60)}") for i, (_, b) in enumerate(pairs)] + [(1000 + i, prose(rng, w, 200)) for i in range(150)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.links(docs, spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id bigint, text string")).collect()}
    assert len(got & {(i, i) for i in range(150)}) >= 0.9 * 150 and not [g for g in got if g[0] != g[1]]


def test_names_do_not_depend_on_the_rest_of_a_text(spark):
    a = "Tom bought 12 apples at the market for 3 dollars each. Tom sold 7 of them for 5 euros each. Tom lost the rest."
    b = "Mary Ann bought thirty apples at the market for $4 each. Mary Ann sold 9 of them for 6 pounds each. Mary Ann lost the rest."
    items = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    texts = [b, "mary ann is here, " + b, a.replace("12", "twelve"), b.replace("Mary Ann lost", "Bob lost")]
    got = {r.doc_id: r for r in decontaminate.links(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), items).collect()}
    assert set(got) >= {0, 1, 2} and got[0].n_slots >= 4 and got[0].share > 0.9 and got[2].n_slots == 1


def test_ids_of_any_type(spark, benchmark):
    docs = spark.createDataFrame([("x", ITEM)], "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.links(docs, benchmark).collect()] == [("x", 1)]


def test_decontamination_of_nothing(spark, benchmark, empty):
    assert decontaminate.links(empty, benchmark).count() == 0
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert decontaminate.links(docs, benchmark.limit(0)).count() == 0 and decontaminate.clean(docs, benchmark.limit(0)).count() == 1
    assert decontaminate.clean(docs, benchmark).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, root).toPandas()
    whole = spark.read.parquet(f"{root}/documents.parquet").toPandas()
    assert 0 < out.doc_id.nunique() < len(whole) and set(out.doc_id) <= set(whole.doc_id)
    assert not any(secrets.find(t) for t in out.text)
    labels = spark.read.parquet(f"{root}/labels.parquet").toPandas()
    stage = corpus_pipeline.keep_good(spark, spark.read.parquet(f"{root}/documents.parquet"), root).toPandas()
    kept = labels.assign(kept=labels.doc_id.isin(stage.doc_id)).groupby("quality").kept.mean()
    assert kept[1] > 0.9 and kept[0] < 0.2
    for k, (_, run) in enumerate(corpus_pipeline.STAGES):
        for frame in (docs, empty):
            got = run(spark, frame, root)
            got.write.mode("overwrite").parquet(f"{tmp_path}/out")
            back = spark.read.parquet(f"{tmp_path}/out")
            last = k == len(corpus_pipeline.STAGES) - 1
            assert back.columns[: len(frame.columns)] == frame.columns and len(back.columns) == len(frame.columns) + last
            assert back.count() == 0 if frame is empty else back.count() > 0


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    """Every stage's decision by other means: SQL for votes and mixing, plain loops for near copies, passages and secrets."""
    import math

    import corpus_pipeline
    import duckdb
    import pandas as pd

    from driftline.llm import mixing, quality

    rng, w = random.Random(21), vocabulary(22, 300)
    asked = [prose(rng, w, 30) for _ in range(4)]
    held = {d: (d, t, lang, source, n) for d, t, lang, source, n in rows if d is not None and d != 3}
    for k in range(60):
        text = prose(rng, w, rng.randint(25, 90))
        if k % 6 == 1:
            text += " " + asked[k % 4] + " end"
        if k % 6 == 2:
            text += f" password = hunter{k}x and AKIA{'Z' * 16} or {'0f' * 13}"
        if k % 6 == 3:
            text = held[997 + k][1].replace(" ", "  ", 1) if 997 + k in held else text
        if k % 6 == 4:
            text = " ".join(x + "###" for x in text.split())
        held[1000 + k] = (1000 + k, text, "en", f"s{k % 4}", len(text))
    docs = sorted(held.values())
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.repetition, r.text, r.source, r.n_chars) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    def sql(text, now):
        db = duckdb.connect()
        db.register("documents", pd.DataFrame(now, columns=names).astype({"n_chars": "Int64"}))
        return db.execute(text).df()

    voted = sql(quality.oracle(), docs)
    good = set(voted[voted.kept].doc_id)
    now = [d for d in docs if d[0] in good]
    groups = brute.near_groups([d[:2] for d in now])
    now = [d for d, g in zip(now, groups, strict=True) if d[0] == min(e[0] for e, h in zip(now, groups, strict=True) if h == g)]
    now = [d for d in now if not any(brute.passages(d[1], a) for a in asked)]
    clean = []
    for d, text, lang, source, n in now:
        out, at = [], 0
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in brute.secrets(text)):
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        changed = "".join([*out, text[at:]])
        clean.append((d, changed, lang, source, n if changed == text else len(changed)))
    want = []
    by_id = {d[0]: d for d in clean}
    for r in sql(mixing.oracle(), clean).itertuples():
        _, text, _, source, n = by_id[r.doc_id]
        for k in range(math.ceil(r.taken / r.size) if r.taken else 0):
            part = r.taken - k * r.size
            cut = text if part >= r.size else " ".join(brute.words(text)[:part])
            want.append((r.doc_id, k + 1, cut, source, n if part >= r.size else len(cut)))
    assert [g[:4] for g in got] == sorted(x[:4] for x in want) and Counter(g[4] for g in got) == Counter(x[4] for x in want)
    assert len(good) < len(docs) and len(now) < len(good) and any("[SECRET]" in g[2] for g in got)


def long_der(size, fill):
    """A key's header that claims so many bytes, and what it would hold."""
    return b"\x30\x82" + size.to_bytes(2, "big") + b"\x02\x01\x00" + fill


@pytest.mark.parametrize(
    "text",
    [
        "\n".join([b64(FRAME[:60]).rstrip("=")[:76]] * 26_000),
        "\n".join([b64(FRAME)[:-8]] * 5_000),
        b64(long_der(60_000, b"\x02\x01\x05")) * 140_000,
        b64(long_der(60_000, b"\x04\x82\x75\x30\x04")) * 100_000,
        "MIIE" * 400_000,
        url64(b'{"alg":"x"') * 140_000 + ".x.y",
        (url64(b'{"a":') + "x") * 200_000 + ".e30.x",
        f"{JWT} " * 12_000,
        "eyJ" * 660_000,
        (JWT + ".") * 12_000,
    ],
    ids=["headers of frames", "frames cut short", "claims", "strings that end early", "claims side by side", "open headers", "nested headers", "tokens", "starts of headers", "tokens in a row"],
)
def test_long_texts_end_soon(text):
    import time

    began = time.process_time()
    secrets.find(text)
    assert time.process_time() - began < 10


def test_spans_within_others_go_once():
    rng = random.Random(8)
    make = lambda: [("k", s := rng.randrange(100), s + rng.randrange(1, 30)) for _ in range(40)]
    for _ in range(50):
        spans, sure = make(), make()[:10]
        assert list(secrets._apart(spans, sure)) == [(k, s, e) for k, s, e in spans if not any(x <= s and e <= y for _, x, y in sure)]
