import hashlib
import random

import public_tokenizers
import sentencepiece
from runledger.llm import sentencepiece_table as st

MODEL = st.read_model(public_tokenizers.path("piece_bpe_32k.model"))
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b   c ", "▁a ▁ b", "\n\ta\n b", "<s> x </s> [INST]", "\x00", "café \U0001f389 　x", "word " * 5000, "x" * 20000, " " * 300 + "y", "▁"]


def expected(text):
    ids = SP.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_table_equals_library():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab  e\n▁é.tion") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for limit in (10, 10**6):
        known = st.ChunkTable(MODEL, limit)
        for i in range(0, len(texts), 100):
            for t, ids in zip(texts[i : i + 100], known.encode(texts[i : i + 100]), strict=True):
                assert ids.tolist() == SP.encode(t), t


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, "", "x"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").drop("n_tokens")
    got = st.digests(st.encode_documents(docs, MODEL), MODEL).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *expected(t or "")) for i, t, _ in rows), key=str)
    assert st.digests(st.encode_documents(docs.limit(0), MODEL), MODEL).count() == 0


def test_other_columns_pass(spark):
    docs = spark.createDataFrame([(1, "a b", "clash")], "doc_id long, text string, decoded string")
    row = st.encode_documents(docs, MODEL).first()
    assert row.decoded == "clash" and row.ids == SP.encode("a b")


def test_whole_table_against_library(spark):
    from runledger.llm import queries

    name, folder = "op10_sentencepiece", "/root/testdata/sf0.001"
    got = {r[0]: tuple(r)[1:] for r in queries.queries()[name](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: expected(r.text or "") for r in docs}


def test_refuses_pieces_across_marks():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    assert not st.pieces_stay_within_marks(Crossing())
    assert st.pieces_stay_within_marks(SP)


def test_ids_and_their_texts_take_one_python_worker_a_task(spark):
    import corpus_pipeline as cp
    from runledger.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (queries.queries()["op10_sentencepiece"](spark, folder), dict(cp.STAGES)["sentencepiece"](spark, docs, folder)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_round_trip_equals_encode_and_decode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in st.round_trip_documents(docs, MODEL).collect()}
    assert got == {i: (SP.encode(t), SP.decode(SP.encode(t))) for i, t in enumerate([*TEXTS, ""])}
    assert st.digests(st.round_trip_documents(docs.limit(0), MODEL)).count() == 0
