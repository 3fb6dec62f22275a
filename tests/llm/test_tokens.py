"""Token pieces, packing and token files against the tokenizers library and brute force."""

import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rivermeld.llm import packing, token_files, tokens
from rivermeld.llm.shared import table
from rivermeld.session import new_folder

SF_DIR = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(tokens.default_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbz ÉéßſΣσςİıǅ'’.,!?0١²\t\n\x1c\x1d\x85\xa0́ <|endoftext|>ﬁ中🙂µªº"), max_size=30))
def test_words_one_by_one_give_the_ids_of_the_text(text):
    assert tokens.encoder(tokens.default_path())(text) == packed(ids_of(text))


def test_generations_bound_the_words_held(monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 3)
    words = tokens._Words(LIBRARY)
    text = "one two three four five one, two. six One"
    assert b"".join(map(words.__getitem__, text.split())) == packed(ids_of(text))
    assert len(words) <= 4 and len(words.old) <= 4


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉßªµ1.,'!?*#$%&<>|_ \n"), max_size=30))
def test_letters_before_marks_give_the_ids_of_the_text(text):
    assert tokens.encoder(tokens.default_path())(text) == packed(ids_of(text))


def test_words_that_differ_in_case_and_marks_are_encoded_once():
    class Counted:
        model = property(lambda self: self)
        calls = 0

        def tokenize(self, word):
            self.calls += 1
            return LIBRARY.model.tokenize(word)

        def encode(self, *a, **b):
            self.calls += 1
            return LIBRARY.encode(*a, **b)

    words = tokens._Words(counted := Counted())
    text = "word Word WORD word*** Word,### *** ,###"
    assert b"".join(map(words.__getitem__, text.split())) == packed(ids_of(text))
    assert counted.calls == 3


def check_packing(rows, texts, end_id, capacity=packing.Capacity()):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = ids_of(texts[doc_id]) + [end_id]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            part = ids[at:at + r["length"]]
            assert r["start"] == at and zlib.crc32(packed(part)) == r["ids_crc32"]
            assert r["length"] == capacity.longest() or k == len(pieces) - 1
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity.tokens and len(pieces) <= capacity.documents
        assert sum(r["length"] ** 2 for r in pieces) <= capacity.attention
    return len(by_sequence)


def test_packing_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF_DIR, "documents").collect()}
    rows = packing.op3(spark, SF_DIR).collect()
    n = check_packing(rows, texts, 1)
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert n <= least + 1


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_every_capacity_binds(spark, docs, measure):
    texts = {i: "word " * (i % 37) for i in range(300)} | {300: None, 301: "", 302: "long " * 5000}
    capacity = packing.Capacity(tokens=256, documents=4, attention=40_000)
    rows = packing.packed_documents(docs(list(texts.items())), 1, capacity, packing.Fit(measure)).collect()
    check_packing(rows, texts, 1, capacity)


def test_packing_of_odd_rows(spark, docs):
    assert packing.packed_documents(docs([])).count() == 0
    rows = packing.packed_documents(docs([(None, "a b"), (None, "a b"), (1, None), (1, None)])).collect()
    assert len(rows) == 4 and len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows)[0] == 0


def brute_files(rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text) + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
    return out


def test_token_files_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect()]
    got = sorted(tuple(r) for r in token_files.op9(spark, SF_DIR).collect())
    assert got == brute_files(rows)


def test_token_files_of_odd_rows(spark, docs):
    folder = new_folder(spark, "token-files")
    assert token_files.read_tokens(token_files.write_tokens(docs([]), folder)).count() == 0
    rows = [(3, "x y"), (None, "null"), (3, "x y"), (1, None), (2, ""), (-5, "minus " * 9000)]
    got = token_files.read_tokens(token_files.write_tokens(docs(rows), folder, frame_ids=1000)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == brute_files(rows)


def test_manifest_of_many_shards_is_few_files(spark, docs):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = [(i, f"word {i}") for i in range(400)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = token_files.write_tokens(docs(rows), new_folder(spark, "token-files"))
        assert manifest.count() > 30 and len(manifest.inputFiles()) <= 8
        got = token_files.read_tokens(manifest).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == brute_files(rows)


class Counting(io.BytesIO):
    read_bytes = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        self.read_bytes += n
        return super().read(n)


def test_reader_takes_only_the_wanted_frames_and_sees_damage():
    stream = io.BytesIO()
    file = token_files.TokenFile(stream, frame_ids=500)
    rng = np.random.default_rng(0)
    held = [rng.integers(0, 49_000, n).astype("<u4").tobytes() for n in (0, 3, 499, 2300, 1, 450, 450, 450)]
    for k, ids in enumerate(held):
        file.add(None if k == 1 else k, ids)
    assert file.close() == sum(map(len, held)) // 4
    data = stream.getvalue()
    source = Counting(data)
    reader = token_files.TokenReader(source)
    before = source.read_bytes
    assert reader.document(5) == held[5]
    assert source.read_bytes - before < 4 * 500
    assert [reader.document(k) for k in range(len(held))] == held
    assert reader.null.tolist() == [k == 1 for k in range(len(held))]
    broken = bytearray(data)
    broken[int(reader.places[1]) + 40] ^= 1
    with pytest.raises(Exception):
        token_files.TokenReader(Counting(bytes(broken))).document(2)
