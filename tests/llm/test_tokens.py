import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from planloom.llm.tokens import cut_texts, encode_corpus

T = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
T.encode_special_tokens = True


def test_exact(spark):
    shared = "The release checklist was signed off in one round, as the status had not been kept up to date. " * 6
    texts = [
        None, "", " ", "a", "don't  won't   we'll", "<|endoftext|> in a text", "งานล่าช้าสองวัน" * 40, shared, "x" + shared, shared + "\r\n\r\n" + shared, "\n \n  tail  ", "👩‍💻👨‍👩‍👧 ½ №5",
        "aaaa" * 400, "1234567890" * 60, " " * 700, "x" * 3000 + " " + "é" * 3000, "Ước lượng công sức vẫn mở suốt một tuần " * 30, shared * 40,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, " ", "x")], "doc_id long, text string, ids string")
    for size in (16, 256):
        got = encode_corpus(df, mean_chunk=size).collect()
        assert {r.doc_id: list(r.ids) for r in got} == {i: T.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
        assert len(got) == len(texts)
    assert encode_corpus(df.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_cuts_keep_text(texts):
    assert ["".join(x) for x in cut_texts(texts, 16)] == texts


def test_cuts_hang_on_content():
    body = "Some words that stand in two documents, and go on for a while, with 17 numbers and more. " * 5
    a, b = cut_texts(["intro. " + body, "another beginning here: " + body], 16)
    assert len(set(a) & set(b)) > len(set(a)) / 2
