"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orewell.llm import language, mixing, neardup, packing, quality, queries, rans, rules, secrets, substrings, topk
from orewell.llm.common import TextEncoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, node string, size string, spans string, bands string, root string, length string, h string, digest string, factor string, row string, common string, removed string, __source string, __prob string, __k string, __id string"
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "su") for b in ("na", "ri", "to", "ve") for c in ("", "n", "s", "rt", "ld")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(VOCABULARY) + str(r.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 300)
    near = base.split(" ")
    near[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "short text"), (8, prose(8, 60_000)), (9, prose(9, 120)), (9, prose(9, 120)), (None, prose(10, 90)), (11, "日本語のテキスト と кириллица " * 20)]
    return rows + [(20 + i, prose(100 + i, 80)) for i in range(12)]


def documents(spark, rows):
    full = [(i, t, None if i == 7 else "la", None if i == 9 else f"s{(i or 0) % 2}", len(t) if t is not None else None, *["x"] * 16) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# 1: secret scans


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def rsa_key() -> bytes:
    r = random.Random(3)
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + r.randbytes(64)) for _ in range(8)))


def test_secrets_are_confirmed_by_structure():
    key = base64.b64encode(rsa_key()).decode()
    assert [k for k, _, _ in secrets.find_spans("key " + key)] == ["der_key"]
    assert "der_key" in [k for k, _, _ in secrets.find_spans("key " + rsa_key().hex())]
    broken = bytearray(rsa_key())
    broken[3] ^= 1  # the outer length no longer fits
    assert not secrets.find_spans("key " + base64.b64encode(bytes(broken)).decode())
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'a'})}.c2lnbmF0dXJl"
    assert secrets.find_spans(token) == [("jwt", 0, len(token))]
    assert not secrets.find_spans(f"{part({'typ': 'x'})}.{part({'sub': 'a'})}.c2lnbmF0dXJl")


def lines_of(s: str, width: int = 64, joint: str = "\n") -> str:
    return joint.join(s[i : i + width] for i in range(0, len(s), width))


def spans_beyond_patterns(text):
    return [(k, text[s:e]) for k, s, e in secrets.find_spans(text) if k not in secrets.BASE]


def test_secrets_with_escaped_line_ends_and_header_lines():
    key = base64.b64encode(rsa_key()).decode()
    for joint in ("\n", "\\n", "\\r\\n", "\\\\n"):
        pem = f"-----BEGIN RSA PRIVATE KEY-----{joint}{lines_of(key, joint=joint)}{joint}-----END RSA PRIVATE KEY-----"
        assert spans_beyond_patterns('{"private_key": "' + pem + joint + '"}') == [("der_key", pem)]
        assert ("der_key", lines_of(key, joint=joint)) in spans_beyond_patterns(f"begin{joint}{lines_of(key, joint=joint)}{joint}end of text")
    head = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"
    body, last = random.Random(6).randbytes(608), "\n-----END RSA PRIVATE KEY-----"
    pem = head + lines_of(base64.b64encode(body).decode()) + last
    assert spans_beyond_patterns("a " + pem + " b") == [("der_key", pem)]
    assert not spans_beyond_patterns(head + lines_of(base64.b64encode(body[:-1]).decode()) + last)  # no whole blocks


def test_secrets_in_wrapped_lines():
    key = base64.b64encode(rsa_key()).decode()
    for width in (64, 76):
        assert spans_beyond_patterns("the key\n" + lines_of(key, width) + "\nand more words") == [("der_key", lines_of(key, width))]
        assert spans_beyond_patterns("hex:\n  " + lines_of(rsa_key().hex(), width, "\n  ")) == [("der_key", lines_of(rsa_key().hex(), width, "\n  "))]
    assert not spans_beyond_patterns("the key\n" + lines_of(key[:-8]) + "\nand more words")


def test_secrets_inside_encoded_text():
    key = base64.b64encode(rsa_key()).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines_of(key)}\n-----END RSA PRIVATE KEY-----\n"
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o, indent=1).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'a'})}.c2lnbmF0dXJl"
    for kind, held in (("der_key", pem), ("jwt", f'{{"token": "{token}", "more": "none"}}')):
        value = base64.b64encode(held.encode()).decode()
        assert value[0] not in "Mb"
        assert spans_beyond_patterns(f"data:\n  tls.key: {value}\n") == [(kind, value)]
        assert spans_beyond_patterns(f"words\n{lines_of(value, 76)}\n\nmore words")[0][0] == kind
        assert spans_beyond_patterns("x " + held.encode().hex() + " y") == [(kind, held.encode().hex())]


def test_tokens_whatever_their_first_character_and_wrapped():
    part = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    for head in ('{"alg":"HS256"}', '{ "alg": "HS256"}', '{\n "alg": "HS256"}', ' {"alg": "HS256"}'):
        token = f"{part(head)}.{part('{"sub": "somebody with a long name"}')}.c2lnbmF0dXJlc2lnbmF0dXJl"
        for a, b in (("", ""), ("Bearer ", " x"), ("see.", ". Then"), ("word\n", "\nword")):
            assert spans_beyond_patterns(a + token + b) == [("jwt", token)]
        assert spans_beyond_patterns("word\n" + lines_of(token, 20) + "\nword or more") == [("jwt", lines_of(token, 20))]


def test_base_rules_of_secrets():
    text = 'é API_KEY: "abcdef" token=abc AKIA' + "A" * 16 + " " + "0a" * 12
    assert secrets.find_spans(text) == [("assign", 2, 18), ("access", 30, 50), ("hex", 51, 75)]


def test_secret_report_and_redaction(docs, empty, spark):
    assert secrets.secret_report(docs).count() == docs.count()
    assert secrets.secret_report(empty).count() == 0
    some = documents(spark, [(1, "password = hunter22 and more"), (2, None), (2, None)])
    out = secrets.redact_secrets(some)
    assert out.columns == some.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in out.orderBy("doc_id").collect()] == [(1, "[secret:assign] and more", 24), (2, None, None), (2, None, None)]


BASE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id,
    len(list_filter(regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_base_rules_of_secrets_equal_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    got = secrets.secret_report(spark.read.parquet(path)).select("doc_id", "n_assign", "n_access", "n_hex").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(BASE_SQL).fetchall())


def test_secret_spans_equal_a_plain_search(spark):
    """base_sha256 against spans found by the contract's own patterns, text by text."""
    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    r, bits = random.Random(12), ["password: ", "API_KEY='", "token=", "secret", " = ", "abcdef123", "AKIA", "Z9" * 10, "0af3" * 7, "é", "\n", '"', "ab12", " "]
    some = ["".join(r.choice(bits) for _ in range(60)) for _ in range(200)]
    docs = documents(spark, [*enumerate(some), (900, None), (901, "")])
    got = {x.doc_id: x for x in secrets.secret_report(docs).collect()}
    for key, text in [*enumerate(some), (900, ""), (901, "")]:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least)
        joined = ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in spans)
        assert got[key].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in got[key].spans.split(",") if x.split(":")[0] in secrets.BASE] == [x for x in joined.split(",") if x] or got[key].spans == joined == ""


def test_unsigned_tokens_are_not_reported():
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    assert not spans_beyond_patterns(f"{part({'alg': 'none'})}.{part({'sub': 'somebody'})}.")
    assert not spans_beyond_patterns(f"{part({'alg': 'none'})}.{part({'sub': 'somebody'})}.c2lnbmF0dXJl")


# 2: near-duplicates


def shingles(text):
    words = text.split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_classes(rows, least=0.8):
    sets = [None if t is None else shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i] == rows[j]
            alike = same_id or (a is not None and b is not None and (a == b if not (a and b) else len(a & b) >= least * len(a | b)))
            if alike:
                parent[top(i)] = top(j)
    groups: dict[int, list] = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(key)
    return sorted((tuple(sorted(g, key=repr)) for g in groups.values()), key=repr)


def found_classes(df):
    groups: dict = {}
    for n, r in enumerate(df.collect()):
        groups.setdefault(r.class_id if r.class_id is not None else f"none{n}", []).append(r.doc_id)
    return sorted((tuple(sorted(g, key=repr)) for g in groups.values()), key=repr)


def test_near_duplicate_classes_equal_brute_force(docs, empty, spark):
    assert found_classes(neardup.classes(docs)) == brute_classes(texts())
    assert neardup.classes(empty).count() == 0


def test_near_duplicates_in_wide_buckets(spark):
    """Families around one text: chains of edits, and many texts that share half their words without being alike."""
    r, shared, rows = random.Random(5), prose(77, 100), []
    for i in range(120):
        rows.append((i, shared + " " + prose(1000 + i, 80)))
    for i in range(40):
        words = prose(500 + i % 4, 200).split()
        for _ in range(i % 7):
            words[r.randrange(len(words))] = f"e{i}"
        rows.append((1000 + i, " ".join(words)))
    assert found_classes(neardup.classes(documents(spark, rows))) == brute_classes(rows)


def test_keep_one_returns_the_columns_and_one_row_of_each_class(docs):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(9) == 1 and None in ids and 4 in ids


def test_dart_signatures_agree_as_often_as_the_weighted_similarity():
    r = np.random.default_rng(1)
    e = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    wa, wb = r.uniform(0.2, 5, 400), r.uniform(0.2, 5, 400)
    sig = neardup.signatures(np.repeat([0, 1], 400), np.concatenate([e, e]), np.concatenate([wa, wb]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


# 3 and 8: classifiers, by held-out accuracy


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_quality_neighbours(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    one, none = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in none])
    assert auc > 0.85


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2 if i != 22 else None, "x") for i in range(20, 32)], "doc_id long, quality int, text string")
    out = quality.quality_scores(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


def test_repeated_rows_and_ids_take_no_votes(spark):
    """One id on a hundred thousand rows: the driver gets one row for each different text and label."""
    docs = spark.range(100_000).select(F.lit(1).alias("doc_id").cast("long"), F.lit("one text again and again").alias("text"))
    docs = docs.unionByName(documents(spark, [(i, prose(i, 60)) for i in range(2, 42)]).select("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 42)] * 3 + [(5000 + i, 1) for i in range(500)], "doc_id long, quality int")
    model = quality.fit(docs, labels, voters=20)
    assert len(model.labels) == 20
    assert len(quality.fit(docs, labels).labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 42))


def test_votes_equal_brute_force(spark):
    """Scores against cosine votes of all voters, taken one document at a time."""
    docs, labels = documents(spark, texts()), spark.createDataFrame([(i, i % 2) for i in range(20, 32)], "doc_id long, quality int")
    model, f = quality.fit(docs, labels, nearest=5), quality.Featurizer()
    for r in quality.score_quality(docs, model).collect():
        text = [t for k, t in texts() if k == r.doc_id][0]
        if not (text or "").split():
            assert r.score == model.prior
            continue
        near = sorted(((float(v), int(y)) for v, y in zip(model.vectors(f([text]))[0] @ model.voters, model.labels, strict=True)), key=lambda x: -x[0])[:5]
        weights = [max(v, 0) ** 8 + 1e-6 for v, _ in near]
        assert abs(r.score - sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)) < 1e-4


def test_rows_without_an_id_are_not_held_out(spark):
    docs = documents(spark, [(None, prose(1, 60)), (3, prose(2, 60))])
    assert all(r.held_out is False for r in quality.quality_scores(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).collect() if r.doc_id is None)
    assert [r.held_out for r in language.document_languages(docs).where("doc_id is null").collect()] == [False]


def test_numerals_are_no_letters(spark):
    docs = documents(spark, [(1, "½ ² ①"), (2, "Ⅷ 12 ..."), (3, "ª½ab cd"), *[(20 + i, prose(i, 50)) for i in range(5)]])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.document_languages(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "la"


def test_viterbi_equals_brute_force(spark):
    """The best path over all labellings of short word rows."""
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the cat sat on the mat and the dog", "en"), ("le chat est sur la table avec le chien", "fr"), ("der hund und die katze sind auf dem tisch", "de")] * 4)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    lab, r = language.Labeler(model), random.Random(4)
    pool = "the cat le chat der hund und table mat avec dem".split()
    for _ in range(20):
        words = [r.choice(pool) for _ in range(6)]
        got = lab.labels([words])[0]
        scores = lab.table[[lab.at[w] for w in words]]
        value = lambda path: sum(scores[i][k] for i, k in enumerate(path)) - lab.switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert abs(value(got) - max(value(p) for p in itertools.product(range(len(model.langs)), repeat=6))) < 1e-3


def test_language_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_viterbi(spark, sf).join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def test_language_edges(docs, empty):
    out = {r.doc_id: r for r in language.document_languages(docs).collect()}
    assert [out[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and out[1].lang_pred == "la"
    assert language.document_languages(empty).count() == 0


# 4: mixing


def test_raked_margins_meet_their_targets(spark):
    rows = [(a, b, "t", 10 + 7 * i + 3 * j) for i, a in enumerate("pqr") for j, b in enumerate("xy")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("p", 0.5), ("q", 0.3), ("r", 0.2)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "lang string, target double")}
    raked = mixing.rake(cells, targets, rounds=15).withColumn("w", F.col("tokens") * F.col("factor"))
    total = sum(r[3] for r in rows)
    assert {r.source: round(r.w / total, 4) for r in raked.groupBy("source").agg(F.sum("w").alias("w")).collect()} == {"p": 0.5, "q": 0.3, "r": 0.2}


def test_margins_tell_convergence_and_what_the_trim_cuts_off(spark):
    cells = spark.createDataFrame([(a, b, c, 100 + 37 * i * j + 11 * k) for i, a in enumerate("pqrs") for j, b in enumerate("xyz") for k, c in enumerate("tu")], "source string, lang string, topic string, tokens long")
    targets = {d: mixing.smoothed(cells, d, mixing.SMOOTHING[d]) for d in mixing.DIMS}
    gap = lambda raked: max(abs(r.target - r.share) for r in mixing.margins(raked, targets).collect())
    assert gap(mixing.rake(cells, targets)) < 1e-4 < gap(mixing.rake(cells, targets, rounds=1)) < gap(mixing.rake(cells, targets, rounds=0))
    few, mixing.FEW_CELLS = mixing.FEW_CELLS, 0
    try:
        assert gap(mixing.rake(cells, targets)) < 1e-4
    finally:
        mixing.FEW_CELLS = few
    skewed = targets | {"source": spark.createDataFrame([("p", 0.97), ("q", 0.01), ("r", 0.01), ("s", 0.01)], "source string, target double")}
    assert max(abs(r.target - r.share) for r in mixing.margins(mixing.rake(cells, skewed, trim=2.0), skewed).collect()) > 0.1


def test_mixing_equals_sql_and_samples_rows(docs, empty):
    assert mixing.mix(empty).count() == 0
    drawn = mixing.mix(docs)
    assert drawn.count() == docs.count()
    sampled = mixing.sample(docs)
    assert sampled.columns == docs.columns
    assert sorted((r.doc_id for r in sampled.collect()), key=repr) == sorted((r.doc_id for r in drawn.where("sampled").collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(repr, con.execute(f"SELECT doc_id, n_tokens, prob, sampled FROM ({mixing.SQL})").fetchall()))
    assert sorted(repr(tuple(r)) for r in drawn.select("doc_id", "n_tokens", "prob", "sampled").collect()) == want


def test_a_rare_source_does_not_shrink_the_pipelines_sample(spark):
    import corpus_pipeline as pipeline

    rows = [(i, prose(3000 + i, 40), "la", f"s{i % 3}") for i in range(900)]
    size = lambda r: pipeline.mix_sources(spark, spark.createDataFrame(r, "doc_id long, text string, lang string, source string"), SF).count()
    few, more = size(rows), size([*rows, (900, "one short text", None, None)])
    assert abs(few - 450) < 45 and abs(more - few) < 20


def test_the_scale_holds_the_stated_share_of_tokens(spark):
    cells = spark.createDataFrame([("a", 1000, 0.5), ("b", 100, 3.0), ("c", 10, 8.0), ("d", 0, 1.0)], "source string, tokens long, factor double")
    for hold in (0.1, 0.5, 0.9):
        probs = {r.source: r.prob for r in mixing.scaled(cells, hold).collect()}
        assert abs(1000 * probs["a"] + 100 * probs["b"] + 10 * probs["c"] - 1110 * hold) < 0.001 and max(probs.values()) <= 1
    assert {r.prob for r in mixing.scaled(cells.where("tokens = 0"), 0.5).collect()} == {1.0}


# 5: packing


def library_ids(name, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], np.uint32)


def test_packing_places_every_piece_without_gaps(docs, empty):
    rows = packing.pack_documents(docs).collect()
    want = []
    for key, text in texts():
        ids = library_ids("byte_bpe_50k.json", text, 0)
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(want, key=repr)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_plans_hold_the_histogram_and_waste_little():
    hist = np.zeros(257, np.int64)
    np.add.at(hist, np.random.default_rng(2).integers(1, 257, 20_000), 1)
    held, n = np.zeros(257, np.int64), 0
    for lengths, times in packing.plan(hist):
        assert sum(lengths) <= 256
        n += times
        for x in lengths:
            held[x] += times
    assert (held == hist).all() and n <= 1.02 * -(-(hist * np.arange(257)).sum() // 256) + 1


# 6: token files


def test_blocks_are_exact_and_can_be_entered_at_checkpoints():
    r = np.random.default_rng(7)
    ids = np.minimum(r.zipf(1.3, 30_000), 49_000).astype(np.int64)
    table = rans.Table.of_counts(np.bincount(ids))
    payload = rans.encode_ids(ids, table, lanes=16, check=64)
    assert (rans.decode_ids(payload, table) == ids).all() and (rans.decode_ids(payload, table, 20_001, 20_777) == ids[20_001:20_777]).all()
    assert len(rans.decode_ids(rans.encode_ids(ids[:0], table), table)) == 0
    broken = bytearray(payload)
    broken[-1] ^= 255
    with pytest.raises(ValueError):
        rans.decode_ids(bytes(broken), table)


def test_token_files_hold_the_librarys_ids(docs, empty, spark):
    rows = sorted(map(tuple, rans.written_documents(docs).collect()), key=lambda r: r[1])
    ids = {key: library_ids("word_bpe_49k.json", text, 2) for key, text in texts()}
    assert [r[0] for r in rows] == sorted((k for k, _ in texts()), key=lambda k: (k is not None, k or 0))
    at = 0
    for key, start, n, crc in rows:
        assert (start, n, crc) == (at, len(ids[key]), zlib.crc32(ids[key].tobytes()))
        at += n
    assert rans.written_documents(empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_encoder_gives_the_librarys_ids(name):
    import public_tokenizers

    some = ["It's  a\ttest,\n\n  déjà vu 12345 <|endoftext|>  x \x1c y", "   ", "a  b   c ", "emoji 😀 日本", "ÀÉ ß Ǆ 'LL we'll", "don't\r\nstop\x85now", "x" * 3000]
    some += [prose(3, 50), "".join(random.Random(4).choice("ab '1.\n\té ") for _ in range(2000))]
    got = TextEncoder(public_tokenizers.path(name))(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library_ids(name, t, 0)[:-1].tolist() for t in some]


@pytest.mark.parametrize("name,want", [("byte_bpe_50k.json", [64, 220, 50256, 275]), ("word_bpe_49k.json", [320, 49407, 321])])
def test_literals_of_special_tokens_give_the_librarys_default_ids(spark, name, want):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    default = lambda t: tok.encode(t, add_special_tokens=False).ids
    assert default("a <|endoftext|> b") == want
    some = ["a <|endoftext|> b", "A<|EndOfText|>b", "<|endoftext|>", "<|startoftext|>  x <|endoftext|>\n\ny", "<|endoftext", prose(3, 50), "日本 <|endoftext|> é"]
    got = TextEncoder(public_tokenizers.path(name))(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [default(t) for t in some]
    docs, at = documents(spark, list(enumerate(some))), 0
    crc = lambda t, end: zlib.crc32(np.array([*default(t), end], np.uint32).tobytes())
    if name.startswith("byte"):
        assert {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs).collect()} == {i: crc(t, 0) for i, t in enumerate(some)}
    else:
        for i, start, n, found in sorted(map(tuple, rans.written_documents(docs).collect()), key=lambda r: r[1]):
            assert (start, n, found) == (at, len(default(some[i])) + 1, crc(some[i], 2))
            at += n


# 7: exact top-k


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 4).astype(float) / 8) for i in range(400)]  # many ties
    odd = [(1000, None), (1001, [0.1, None, 0.2, 0.3]), (1050, [float("nan"), 0.0, 0.0, 0.0]), (1100, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (1150, [])]
    table = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in rows] + [(i, v, "x") for i, v in odd], "vec_id long, embedding array<double>, score string")
    q = {i: np.floor(256 * v).astype(int) for i, v in rows}
    want = []
    for i in range(0, 400, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.nearest_products(table).collect())) == want
    assert topk.nearest_products(table.limit(0)).count() == 0


def products(rows, k=5):
    """Brute force in whole numbers: every row with an id divisible by 50 against all other rows of its length."""
    whole = [[int(np.floor(np.float64(256) * x)) if abs(x) < 2**40 else int(x) * 256 for x in v] for _, v in rows]
    out = []
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            best = sorted((-clamp(sum(a * b for a, b in zip(whole[i], whole[j], strict=True))), rows[j][0]) for j in range(len(rows)) if j != i and len(whole[j]) == len(whole[i]))[:k]
            out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_of_large_values_repeated_ids_and_mixed_lengths(spark):
    r = np.random.default_rng(8)
    rows = [(i, list(map(float, r.normal(size=4)))) for i in range(150)]
    rows += [(150 + i, list(map(float, r.normal(size=4) * 1e6))) for i in range(60)] + [(250 + i, list(map(float, r.normal(size=4) * 1e8))) for i in range(10)] + [(300, [1e12, -1e12, 1e11, 3.0])]
    rows += [(400 + i, list(map(float, r.normal(size=3)))) for i in range(60)] + [(50, rows[50][1]), (50, rows[7][1]), (100, rows[100][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    assert sorted(map(tuple, topk.nearest_products(table).collect())) == products(rows)


def test_top_k_rules_blocks_and_vectors_out_in_clusters(spark, monkeypatch):
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 16))
    rows = [(i, list(map(float, centres[i % 40] + 0.01 * r.normal(size=16)))) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 500)
    assert sorted(map(tuple, topk.nearest_products(table).collect())) == products(rows)
    assert topk.evaluated_share(table) < 0.25
    monkeypatch.setattr(topk, "RANGE_BYTES", 0)  # no block is ruled out as a whole
    assert sorted(map(tuple, topk.nearest_products(table).collect())) == products(rows)


# 9: quality rules


def test_rules_equal_sql(docs, empty, spark):
    banner = [(200 + i, f"the same banner line here\n{prose(300 + i, 70 if i % 3 else 8)}\nTHE  same banner line here") for i in range(60)]
    some = documents(spark, texts() + banner + [(300, "one two three " * 60)])
    con = duckdb.connect()
    con.register("documents", some.toPandas().astype({"doc_id": "Int64"}))
    found = con.execute(rules.SQL)
    names = [c[0] for c in found.description]
    got = rules.line_rules(some, min_docs=rules.MIN_DOCS).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
    out = rules.apply_rules(some)
    assert out.columns == some.columns and not [r for r in out.collect() if "banner" in r.text]
    assert rules.line_rules(empty).count() == 0


# 10: substring deduplication


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    passage = prose(42, 80).replace("\n", " ")
    rows = [(i, prose(600 + i, 150)) for i in range(30)]
    rows += [(100 + i, prose(700 + i, 60 + i) + "\n" + passage + "\n" + prose(800 + i, 40)) for i in range(8)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, "inserted words at the front " + rows[1][1])]
    out = substrings.repeated_passages(documents(spark, rows)).collect()
    text = dict(rows)
    assert {r.doc_id for r in out} == {*range(101, 108), 202, 203}
    for r in out:
        assert r.first_doc_id < r.doc_id and r.n_words >= 50
        if 100 < r.doc_id < 108:
            held = text[r.doc_id][r.start : r.end]
            assert held.strip() in passage and len(held.split()) >= 60
    left = {r.doc_id: r.text for r in substrings.without_repeats(documents(spark, rows)).collect()}
    assert left[100] == text[100] and left[5] == text[5] and left[200] is None and not left[202].strip()


@pytest.mark.parametrize("letters", [(1, 1), (2, 5), (3, 9)])
def test_passages_just_over_fifty_words_are_found_at_any_place(spark, letters):
    r = random.Random(7)
    some = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(*letters))) for _ in range(n))
    rows, want = [], {}
    for i in range(600):
        held = some(50 + i % 11)
        for k in (0, 1):
            front = some(r.randint(1, 60)) + " #" + str(2 * i + k) + " "
            rows.append((2 * i + k, front + held + f" {2 * i + k}# " + some(r.randint(1, 60))))
        want[2 * i + 1] = (2 * i + 1, len(front), len(front) + len(held), 50 + i % 11, 2 * i)
    assert sorted(map(tuple, substrings.repeated_passages(documents(spark, rows)).collect())) == sorted(want.values())


def brute_passages(rows, n=50):
    """(doc, first word, end word) of the runs of stretches of n words that a document with a lesser id holds."""
    held: dict = {}
    words = {k: (t or "").split() for k, t in rows}
    for k, ws in words.items():
        for i in range(len(ws) - n + 1):
            held.setdefault(tuple(ws[i : i + n]), set()).add(k)
    out = []
    for k, ws in words.items():
        at = [i for i in range(len(ws) - n + 1) if min(held[tuple(ws[i : i + n])]) < k]
        runs: list = []
        for i in at:
            if runs and i < runs[-1][1]:
                runs[-1][1] = i + n
            else:
                runs.append([i, i + n])
        out += [(k, a, b) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_brute_force(spark, seed):
    """Documents made of shared pieces, with edits, mosaics, copies and other white space."""
    r = random.Random(seed)
    pieces = [prose(9000 + 100 * seed + i, r.randint(20, 90)).split() for i in range(30)]
    rows = []
    for k in range(120):
        ws = [w for _ in range(r.randint(1, 5)) for w in r.choice(pieces)]
        for _ in range(r.randint(0, 3)):
            ws[r.randrange(len(ws))] = f"e{k}"
        rows.append((k, "".join(w + r.choice([" ", "\n", "  "]) for w in ws)))
    rows += [(500 + i, rows[i][1]) for i in range(10)]
    text, got = dict(rows), []
    for x in substrings.repeated_passages(documents(spark, rows)).collect():
        first = len(text[x.doc_id][: x.start].split())
        assert x.first_doc_id < x.doc_id and x.n_words == len(text[x.doc_id][x.start : x.end].split())
        got.append((x.doc_id, first, first + x.n_words))
    assert sorted(got) == brute_passages(rows)


def test_passages_are_found_beside_an_earlier_document_with_their_middle_only(spark):
    held = prose(91, 60).replace("\n", " ")
    rows = [(1, prose(92, 50) + " " + " ".join(held.split()[10:50]) + " " + prose(93, 50))]
    rows += [(i, prose(94 + i, 50) + f" {i} " + held + f" {i} " + prose(194 + i, 50)) for i in (2, 3)]
    assert [(r.doc_id, r.n_words, r.first_doc_id) for r in substrings.repeated_passages(documents(spark, rows)).collect()] == [(3, 60, 2)]


def test_substring_edges(docs, empty):
    out = substrings.repeated_passages(docs)
    assert {r.doc_id for r in out.collect()} == {2, 3}
    assert substrings.repeated_passages(empty).count() == 0


# The pipeline


def test_stages_keep_other_columns_and_take_odd_rows(docs, empty, spark):
    """Nulls in every column, empty and long texts, equal rows, and columns named like the operators' own."""
    import corpus_pipeline as pipeline

    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r["__k"] == r["row"] == r["common"] == "x" for r in out.collect()), name
        assert f(spark, empty, SF).count() == 0
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}
    nothing = documents(spark, []).union(documents(spark, [(1, "x")]).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    for name, f in pipeline.STAGES:
        assert f(spark, nothing, SF).count() <= 1, name
    assert [c for c in substrings.without_repeats(docs).columns] == docs.columns



def test_each_stage_of_the_pipeline_keeps_the_columns_and_takes_effect(spark):
    import corpus_pipeline as pipeline

    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, held = spark.read.parquet(f"{SF}/documents.parquet"), {}
    kept = {r.doc_id for r in rules.line_rules(docs).where("kept").collect()}
    for name, f in pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF).cache()
        assert docs.columns == names
        held[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(held["quality_rules"]) == kept
    rows = list(held["quality_rules"].items())
    assert sorted(held["near_dedup"]) == sorted(min(g) for g in brute_classes(rows))
    assert held["secret_scan"] == {k: secrets.redact(t) for k, t in held["near_dedup"].items()}
    assert set(held["mix_sources"]) <= set(held["secret_scan"])
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(held["mix_sources"])
    assert sorted(map(repr, ((r.doc_id, r.piece, r.ids_crc32) for r in packed))) == sorted(map(repr, ((r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, SF).collect())))
