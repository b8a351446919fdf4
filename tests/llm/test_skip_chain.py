import re

from hypothesis import given, settings
from hypothesis import strategies as st

from risewatch.llm import skip_chain as S

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(d) <= 19 and S.luhn(d)):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="ab1234567890.@+-() %", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert S.base_spans(text) == plain(text)


def test_long_runs_stay_linear():
    assert S.base_spans("a." * 200_000) == []
    assert S.base_spans("1" * 300_000 + "@") == []


def test_luhn_and_parts():
    assert [k for _, k, _ in S.base_spans("card 4111 1111 1111 1111 ip 10.0.0.256 and 010.1.2.3")] == [2, 1]


TEXTS = [f"mail me{i}@host{i}.org or call +1 (555) 010-{1000 + i} from 10.0.{i % 200}.7 about 4111 1111 1111 1111 today ok" for i in range(40)]


def test_similar_tokens_share_labels(spark):
    # the second mention is glued to digits, so that no rule takes it; the skip edge does
    texts = [*TEXTS, "call +1 (555) 010-1003 now. later words here and there then 010-1003 again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    field = S.Field(S.train(docs, "text"))
    spans = S.detect(docs, "text", field).where("doc_id = 40").first()["spans"]
    assert [(s["kind"], s["base"]) for s in spans][0] == ("phone", True)
    added = [s for s in spans if not s["base"]]
    assert added and added[-1]["kind"] == "phone" and texts[40][added[-1]["start"] : added[-1]["end"]] == "010-1003"


def test_base_spans_stay_and_order(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    field = S.Field(S.train(docs, "text"))
    for r in S.detect(docs, "text", field).collect():
        base = [(s["start"], S.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["base"]]
        assert base == plain(TEXTS[r["doc_id"]])
        starts = [(s["start"], S.KINDS.index(s["kind"])) for s in r["spans"]]
        assert starts == sorted(starts)


def test_counts_are_sums_over_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(5)
    assert (S.train(docs, "text") == S._counts(TEXTS)).all()


def test_beliefs_agree_on_a_tree():
    import numpy as np

    rng = np.random.default_rng(3)
    unary, table = rng.random((4, 3)) + 0.1, rng.random((1, 3, 3)) + 0.1
    edges = np.array([[0, 1, 0], [1, 2, 0], [1, 3, 0]])
    joint = np.einsum("a,b,c,d,ab,bc,bd->abcd", *unary, table[0], table[0], table[0])
    want = [joint.sum(tuple(k for k in range(4) if k != i)) for i in range(4)]
    got = S.beliefs(unary, edges, table, rounds=60)
    assert np.allclose(got, [w / w.sum() for w in want], atol=1e-6)


def test_very_long_digit_runs():
    """Numbers of more digits than an integer may be read from."""
    for text in ("0" * 10_000 + ".1.2.3", "1." * 3000 + "2", "9" * 10_000, "0" * 5000 + "7.0000255.0.256"):
        spans = S.base_spans(text)
        assert all(text[s:e] for s, _, e in spans)
    assert S.base_spans("0" * 5000 + ".1.2.255") == [(0, 1, 5008)]
