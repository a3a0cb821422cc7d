"""Personal data, license scan, language identification, SentencePiece, token files, sharding."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaspan.llm import language_id, license_scan, pii, sentencepiece_codec, sharding, token_files

from . import cases

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def noise(seed, parts, count, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, most))) for _ in range(count)]


def test_pii_base(spark):
    parts = ["a.b", "@", "x", "1", "23", "4111111111111111", "+1 ", "(", "555", ")", "-", " ", ".", "é", "🙂", "c-d.com", "192.168.1.1", "0300", "\n", "%", "12.3.4.5.6", "00255"]
    texts = [*cases.TEXTS, *noise(3, parts, 400, 25), "5" * 20_000, "a" * 20_000, "a@b.cc " * 3000]
    for docs in (cases.documents(spark, texts), cases.sf_documents(spark)):
        rows = pii.op2_pii(docs).collect()
        assert len(rows) == docs.count()
        held = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in rows:
            want = base_spans(held[r["doc_id"]])
            assert [r[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in want) for k in KINDS]
            written = [f"{k}:{a}:{b}" for a, _, k, b in want]
            assert r["base_sha256"] == cases.sha(",".join(written))
            assert set(written) <= set(r["spans"].split(",")) | {""}
    assert pii.op2_pii(cases.empty(spark)).count() == 0


def test_pii_zero_parts(spark):
    """Addresses with parts that are all zeros, and parts that go over 255 behind zeros."""
    texts = ["0.0.0.0", "ip 0.1.2.3 and 00.1.1.1", "000.00.0.0000", "0.256.1.1 0256.1.1.1 0255.0.0.1", "1.0.0.0", "00.", "0" * 20_000 + ".1.2.3"]
    rows = pii.op2_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = base_spans(texts[r["doc_id"]].replace("0" * 19_000, "")) if r["doc_id"] == 6 else base_spans(texts[r["doc_id"]])
        assert r["n_ip"] == sum(x[2] == "ip" for x in want)
        if r["doc_id"] != 6:
            assert r["base_sha256"] == cases.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in want))
    assert {r["doc_id"]: r["n_ip"] for r in rows} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1}


def test_pii_catch_rate(spark):
    """Planted cases of every kind among clean texts: at least nine in ten are reported, and clean texts are left alone."""
    rnd = random.Random(9)
    hexes, word = (lambda n: "".join(rnd.choices("0123456789abcdef", k=n)) + "7a"), (lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9))))
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    plant = {
        "email": lambda: f"write to {word()}.{word()}@{word()}.com", "phone": lambda: f"call +49 30 {digits(4)} {digits(4)}", "local_phone": lambda: f"phone ({rnd.randint(200, 989)}) 555-{digits(4)}", "ip": lambda: f"host 93.{rnd.randint(1, 254)}.10.{rnd.randint(1, 254)}",
        "national_id": lambda: f"ssn 123-4{rnd.randint(1, 9)}-{rnd.randint(1000, 9999)}", "iban": lambda: f"IBAN DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", "name": lambda: f"signed by Dr. Maria {word().title()}",
        "access_key": lambda: "ghp_" + hexes(34), "secret": lambda: rnd.choice([f'token = "{hexes(38)}"', f"password: {word()}{digits(3)}{word()}", f"api_key={hexes(30)}", f"'secret': '{hexes(20)}'"]), "spelled_email": lambda: f"mail {word()} [at] {word()}.org",
    }
    texts, want = [], []
    for kind, make in plant.items():
        for _ in range(40):
            texts.append(" ".join([*(word() for _ in range(20)), make(), *(word() for _ in range(20))]))
            want.append(kind)
    clean = [" ".join(word() for _ in range(60)) + f". Section {k}, table 4.{k}.1 of 2019-04-{k % 28 + 1:02d}, key: value, the token was lost" for k in range(400)]
    rows = cases.by_id(pii.op2_pii(spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")))
    for kind in plant:
        own = [rows[i] for i, k in enumerate(want) if k == kind]
        assert sum(kind + ":" in r["spans"] for r in own) >= 0.9 * len(own), kind
        assert all(r["n_spans"] == r["spans"].count(":") // 2 for r in own)
    assert sum(rows[i]["n_spans"] == 0 for i in range(len(texts), len(texts + clean))) >= 0.98 * len(clean)


def test_pii_redact(spark):
    docs = spark.createDataFrame([(1, "é write to a@b.com now", 3), (2, None, 4), (1, "é write to a@b.com now", 3), (1, "no", 5)], "doc_id long, text string, spans int").selectExpr("*", "7 AS row_", "8 AS row")
    out = pii.redact(docs)
    assert out.columns == ["doc_id", "text", "row_", "row", "spans"]
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, "no"), (1, "é write to <email> now"), (1, "é write to <email> now"), (2, "")]


def test_license_base_and_fuzzy(spark):
    texts = [*cases.TEXTS, "CC-BY cc cc by BY", "General  Public, License general public licenses", "licenced under the apache license version 2.0"]
    docs = cases.documents(spark, texts)
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = license_scan.op3_license_scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = cases.ALNUM.findall((held[r["doc_id"]] or "").translate(cases.AZ))
        want = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(want))
        assert (r["first_word"], r["last_word"]) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in want})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in rows}
    assert by[20]["labels"] == "cc-by,cc-by-nc,reserved" and by[20]["base_labels"] == "cc-by"
    assert by[len(texts) - 1]["labels"] == "apache-2.0"
    assert license_scan.op3_license_scan(cases.empty(spark)).count() == 0


def test_license_neighbouring_copies():
    """Copies of one notice next to each other are all found, whichever of them is the best match."""
    finder = license_scan.NoticeFinder({"licensed under the mit license": "mit"})
    good, bad = "licensed under the mit license", "licensed under the mit licence"
    for copies in ([bad, good], [good, bad], [bad, bad, good, bad], [bad, good, bad, good], [bad] * 5 + [good]):
        found = finder.find(" ".join(copies))
        assert [x[3] for x in found] == [int(c == bad) for c in copies]
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_license_seeds_lose_nothing():
    import regex

    finder, rnd = license_scan.NoticeFinder(), random.Random(5)
    for notice, label in license_scan.NOTICES.items():
        k = license_scan.allowed(notice)
        for _ in range(15):
            t = list(notice)
            for _ in range(k):
                i = rnd.randrange(1, len(t) - 1)
                t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "q", "zz"[:1]])
            text = "some words before " + "".join(t) + " and after"
            if regex.search(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}", text):
                assert label in {x[2] for x in finder.find(text)}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op8_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_edges(spark):
    docs = cases.documents(spark)
    out = cases.by_id(language_id.op8_language_id(docs))
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (0, 1, 2, 3, 16, 17))
    assert out[4]["lang_pred"] in ("en", "de") and 0 < out[4]["score"] <= 1
    assert language_id.op8_language_id(docs).count() == docs.count()
    assert language_id.op8_language_id(cases.empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", docs["source"].substr(99, 1)).select("doc_id", "text").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in language_id.op8_language_id(unlabelled).collect()} == {"und"}


def mixture(bins, logp):
    """Proportions by language of one document."""
    chosen, pi = language_id.infer([bins], language_id.Model([str(k) for k in range(len(logp))], logp))[0]
    out = np.zeros(len(logp))
    out[chosen] = pi
    return out


def test_language_sets_against_all_subsets():
    """The greedy set of languages is never far from the best of all subsets by penalised likelihood, and mostly is it."""
    from itertools import combinations

    rnd, same = np.random.default_rng(5), 0
    for trial in range(30):
        p = rnd.dirichlet(np.full(200, 0.2), size=4)
        logp = np.full((4, language_id.BINS), -20.0, np.float32)
        logp[:, :200] = np.log(p + 1e-9)
        parts = rnd.choice(4, rnd.integers(1, 4), replace=False)
        bins = np.concatenate([rnd.choice(200, int(rnd.integers(150, 500)), p=p[k]) for k in parts])
        u, n = np.unique(bins, return_counts=True)
        value = lambda own: language_id.proportions(np.exp(logp[list(own)][:, u].astype(float)).T, n.astype(float))[1] - language_id.PENALTY * np.log(len(bins) + 1) * len(own)  # noqa: B023, E731
        best = max((s for size in range(1, 5) for s in combinations(range(4), size)), key=value)
        pi = mixture(bins, logp)
        mine = tuple(int(k) for k in np.flatnonzero(pi))
        assert abs(pi.sum() - 1) < 1e-6 and value(mine) >= value(best) - 0.5
        same += mine == best
        assert set(best) == set(parts.tolist())
    assert same >= 28


def test_language_mixture():
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet(np.full(400, 0.05), size=3)
    logp = np.full((3, language_id.BINS), -20.0, np.float32)
    logp[:, :400] = np.log(p + 1e-9)
    bins = np.concatenate([rnd.choice(400, 700, p=p[0]), rnd.choice(400, 300, p=p[2])])
    pi = mixture(bins, logp)
    assert pi[1] == 0 and abs(pi[0] - 0.7) < 0.06
    assert mixture(rnd.choice(400, 500, p=p[1]), logp).tolist() == [0, 1, 0]


@pytest.mark.parametrize("size", [1, 3])
def test_language_blocks(spark, monkeypatch, size):
    """A model of many blocks of languages gives what one block gives."""
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text", F.concat("lang", (F.col("doc_id") % 3).cast("string")).alias("lang"))
    one = {tuple(r) for r in language_id.op8_language_id(docs).collect()}
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", size)
    model = language_id.learn(docs)
    assert len(model.paths) == -(-len(model.names) // size) > 1
    assert {tuple(r) for r in language_id.op8_language_id(docs).collect()} == one


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


PARTS = ["a", "b", "e", "t", "th", " ", "  ", "\n", "é", "日本", "🙂", "ing", "the", "1", "12", "!", "...", "\t", "xxxxx", "0000", "aaaa"]


def test_sentencepiece_equals_library(spark, model):
    codec, library = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [*(t for t in cases.TEXTS if t), *noise(1, PARTS, 800, 60), "the quick " * 50 + "aaaa" * 500 + "x" * 2000]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<i4").tolist()
        assert ids == library.encode(t)
        assert codec.decode(ids) == t


def test_sentencepiece_unigram_is_viterbi(model):
    at = model.index(b"\x18\x02 \x80\xfa\x01")  # the model type, before the size of the vocabulary
    codec = sentencepiece_codec.Codec(model[:at] + b"\x18\x01" + model[at + 2 :])
    for t in noise(2, PARTS, 400, 40):
        best = [(0.0, [])] + [None] * len(t)
        for end in range(1, len(t) + 1):
            for start in range(max(0, end - codec.longest), end):
                k = codec.ids.get(t[start:end])
                if k is None and end - start > 1:
                    continue
                s = best[start][0] + (codec.least if k is None else codec.score[k])
                if best[end] is None or s > best[end][0]:
                    best[end] = (s, best[start][1] + ([k] if k is not None else [codec.bytes[b] for b in t[start:end].encode()]))
        assert codec.ids_of(t) == best[-1][1]


def test_sentencepiece_commits_while_streaming(model):
    """On uncut strings ids are committed as the paths meet: the open window stays within a few pieces' lengths."""
    for kind in (model, model[: model.index(b"\x18\x02 \x80\xfa\x01")] + b"\x18\x01" + model[model.index(b"\x18\x02 \x80\xfa\x01") + 2 :]):
        codec = sentencepiece_codec.Codec(kind)
        for text in ("thequickbrownfoxjumpsoverthelazydog" * 300, "a" * 10_000, "ab" * 5000, "".join(noise(8, ["th", "e", "ing", "a", "r", "st"], 1, 9000))):
            codec.commits = codec.widest = 0
            ids = codec.ids_of(text)
            # In a string that repeats itself the paths may stay apart to its end.
            assert len(set(text)) < 3 or (codec.commits >= len(text) // (8 * codec.longest) and codec.widest <= 8 * codec.longest)
            assert "".join(codec.pieces[i][0] for i in ids) == text


def test_sentencepiece_steps(model):
    """One step a character finds all pieces that end there, and what may stand side by side follows from merges known of each piece."""
    codec = sentencepiece_codec.Codec(model, 2000)  # few steps and facts are kept
    for text in noise(9, [*PARTS, "▁the", "▁", "tion", "ouen"], 60, 40):
        node = codec.root
        for end in range(1, len(text) + 1):
            node = node[text[end - 1]]
            want = [(codec.ids[text[a:end]], end - a) for a in range(max(0, end - codec.longest), end - 1) if text[a:end] in codec.ids]
            assert [(k, w) for k, w, _ in node.pieces] == want and node.one == codec.ids.get(text[end - 1], -1)
    assert 0 <= codec.root.spare[0] < 2000

    def merged(text):
        parts = list(text)
        while True:
            scored = [(codec.score[codec.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in codec.ids]
            if not scored:
                return parts
            at = -max(scored)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    rng = np.random.default_rng(4)
    few, all_ids = [codec.ids[x] for x in ("a", "e", "t", "th", "in", "ing", "aa", "▁", "▁the")], list(codec.ids.values())
    pairs = [(a, b) for a in few for b in few] + [tuple(int(x) for x in rng.choice(all_ids, 2)) for _ in range(3000)]
    for a, b in pairs:
        left, right = codec.pieces[a][0], codec.pieces[b][0]
        assert codec.apart(a, b) == (merged(left + right) == [left, right])
    assert codec.n_pairs <= 2001


def test_sentencepiece_rows(spark):
    docs = cases.documents(spark)
    out = sentencepiece_codec.encode_documents(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] and zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"] for r in rows)
    back = cases.by_id(sentencepiece_codec.decode_documents(out))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(cases.TEXTS))
    assert sentencepiece_codec.encode_documents(cases.empty(spark)).count() == 0


def test_token_files(spark, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for docs in (cases.documents(spark), cases.sf_documents(spark)):
        start = 0
        path, manifest = token_files.write_token_files(docs, partition_bytes=30_000, file_ids=5000)
        got = token_files.read_token_files(spark, path).collect()
        assert len(got) == docs.count() and manifest.count() > 1
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in sorted(got, key=lambda r: r["start"]):
            ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
            assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        # Boundaries and ids of single documents, read from one file.
        name = manifest.orderBy("n_docs", ascending=False).first()["file"]
        with open(path.removeprefix("file://") + f"/data/{name}", "rb") as f:
            file = token_files.TokenFile(f.read())
        by = {r["start"]: r for r in got}
        first = manifest.where(manifest["file"] == name).first()["first_id"]
        for i in reversed(range(file.documents)):
            a, b = file.bounds(i)
            assert file.tokens(a, b).tolist() == by[first + a]["ids"] and b - a == by[first + a]["n_tokens"]
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order)


def test_token_files_in_groups(spark):
    """Many groups of few parts give what one sort gives; rows of one doc_id, or without any, make several parts."""
    docs = cases.sf_documents(spark)
    files = lambda df, **how: token_files.write_token_files(df, partition_bytes=20_000, **how)
    (one, whole), (many, parted) = files(docs), files(docs, group_parts=3)
    assert max(r["part"] for r in parted.collect()) > 6 and parted.agg({"n_ids": "sum"}).first() == whole.agg({"n_ids": "sum"}).first()
    read = lambda path: sorted(token_files.read_token_files(spark, path).collect())
    assert read(one) == read(many) and len(read(one)) == docs.count()
    order = [r["first_id"] for r in parted.orderBy("part", "seq").collect()]
    assert order == sorted(set(order)) and order[0] == 0
    for hot in (docs.selectExpr("7L AS doc_id", "text"), docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text"), docs.selectExpr("IF(doc_id % 3 = 0, doc_id, NULL) AS doc_id", "text")):
        path, manifest = files(hot, group_parts=2)
        got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        assert len(got) == docs.count() and manifest.select("part").distinct().count() > 3
        assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert order == sorted(order)


def test_chunks_equal_whole_texts():
    encoder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=500)
    assert encoder.direct and encoder.nul is not None
    parts = ["a", "The", "t", " ", "  ", "\n", "é", "日本", "🙂", "ing", "'s", "'t", "12", "!", "...", "\t", "½", "5", "_", "-", " ", "　", "²", "<|endoftext|>", ",", "á", "\r\n", "\x1c", "\x00"]
    texts = noise(4, parts, 3000, 30)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == encoder.whole(text)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 4000], list(range(0, 3000, 7)), sorted(random.Random(1).choices(range(10**9), k=1000))])
def test_elias_fano(values):
    ef, end = token_files.EliasFano.read(token_files.EliasFano.of(values).to_bytes(), 0)
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    if len(values) >= 300:
        assert 8 * (len(ef.low) + len(ef.high)) <= len(values) * (3 + max(1, np.log2(values[-1] / len(values))))


def test_sharding(spark):
    for docs in (cases.documents(spark), cases.sf_documents(spark)):
        out = sharding.shuffle_into_shards(docs, shards=5, bucket_bytes=20_000)
        rows = out.collect()
        assert out.columns == [*docs.columns, "shard", "slot", "grown_shard"] and len(rows) == docs.count()
        for s in range(5):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
        assert all(r["grown_shard"] in (r["shard"], 5) for r in rows)
        assert any(r["grown_shard"] == 5 for r in rows)
        again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(docs.repartition(3), shards=5, bucket_bytes=20_000).collect()}
        assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    digest = cases.by_id(sharding.op9_sharding(cases.documents(spark)))
    for i, t in enumerate(cases.TEXTS):
        raw = (t or "").encode()
        assert (digest[i]["size"], digest[i]["text_crc32"], digest[i]["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
    assert sharding.op9_sharding(cases.empty(spark)).count() == 0


def test_sharding_by_groups_and_hot_keys(spark):
    """Groups of buckets one after the other give a permutation as well, and a frequent key or row fills no bucket alone."""
    docs = cases.sf_documents(spark)
    hot = docs.limit(40).selectExpr("CAST(NULL AS LONG) AS doc_id", "text").union(docs.limit(1).selectExpr("7L", "'the same row again and again'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(900)))).drop("n"))
    both = docs.select("doc_id", "text").union(hot)
    out = sharding.shuffle_into_shards(both, shards=3, bucket_bytes=8000, group_buckets=16)
    rows = out.collect()
    assert len(rows) == both.count()
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    path = sharding.write_shards(both, shards=3, bucket_bytes=8000)
    sizes = [r["n"] for r in spark.read.parquet(path).where("doc_id = 7").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < 700


def test_sharding_against_brute_force(spark):
    """Rendezvous and the permutation within buckets, computed apart from the operator."""
    docs = cases.sf_documents(spark).select("doc_id", "text")
    scores = docs.select("doc_id", *[F.xxhash64(F.lit(17), F.lit(s), F.col("doc_id")).alias(f"s{s}") for s in range(25)]).collect()
    best = lambda r, n: max(range(n), key=lambda s: (r[f"s{s}"], s))
    out = sharding.shuffle_into_shards(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["shard"], r["grown_shard"]) for i, r in rows.items()} == {r["doc_id"]: (best(r, 24), best(r, 25)) for r in scores}
    # One bucket a shard here: in hash order before, and no row is more likely to stay than by chance.
    order = {r["doc_id"]: (r["h"], r["t"]) for r in docs.select("doc_id", F.xxhash64(F.lit(19), F.col("doc_id")).alias("h"), F.xxhash64("text").alias("t")).collect()}
    stay = total = 0
    for s in range(24):
        own = sorted((i for i, r in rows.items() if r["shard"] == s), key=order.get)
        assert sorted(rows[i]["slot"] for i in own) == list(range(len(own)))
        stay += sum(rows[i]["slot"] == k for k, i in enumerate(own))
        total += len(own)
    assert total == docs.count() and stay < total / 3


def test_shards_are_written(spark, tmp_path):
    docs = cases.sf_documents(spark)
    path = sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    out = sharding.shuffle_into_shards(docs, shards=4)
    back = spark.read.parquet(path)
    assert sorted(back.select("doc_id", "shard", "slot").collect()) == sorted(out.select("doc_id", "shard", "slot").collect())
    # A file holds a run of slots in order.
    for r in back.groupBy("shard", F.input_file_name().alias("f")).agg(F.collect_list("slot").alias("s")).collect():
        assert r["s"] == list(range(r["s"][0], r["s"][0] + len(r["s"])))
