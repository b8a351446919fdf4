"""Small documents with every awkward case, shared by the tests of the llm operators."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, ids string, decoded string, score string, predicted string, features string, x string, "
    "seed string, overlaps string, licenses string, fingerprint string, n_lines string, n_removed string, gone string, d_id string, h1 string, h2 string, bucket string, batch string, "
    "main_text string, at string, th string, seq string, extra string, id string, n_shingles string"
)
N_EXTRA = len(SCHEMA.split(",")) - 5


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * N_EXTRA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward():
    """Null and empty texts, null ids, repeated rows and ids, one very long text, one without spaces."""
    twin = prose(1, 60)
    return [
        row(5, None), row(None, None), row(6, ""), row(7, "   \n\n\t "), row(None, twin), row(9, twin), row(9, twin), row(9, prose(2, 40)), row(3, twin),
        row(10, prose(3, 30_000)), row(11, "é日" * 4000), row(12, "a"), row(-4, "a b c"), row(13, prose(4, 30), lang=None, source=None),
    ]
