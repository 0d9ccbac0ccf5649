"""Each query over a whole small table, against its SQL or against brute force."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_decontamination", "op8_ngram_jaccard", "op10_warc"])
def test_query_has_the_rows_of_its_sql(spark, name):
    from spanloom.llm.queries import ORACLES, QUERIES

    assert differ(spark, QUERIES[name], ORACLES[name], SF) == ""


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_every_query_has_a_row_for_each_of_its_table(spark):
    from spanloom.llm.queries import QUERIES

    tables = {"op5_nearest_neighbours": None, "op9_html_extraction": ("pages", "page_id"), "op10_warc": ("pages", "page_id")}
    for name in ("op1_mixing", "op3_language_id", "op6_sharding", "op7_surrogates", "op9_html_extraction"):
        table, key = tables.get(name, ("documents", "doc_id"))
        got = sorted(r[key] for r in QUERIES[name](spark, SF).select(key).collect())
        assert got == sorted(r[key] for r in rows(spark, table)), name


def test_line_query_is_brute_force(spark):
    """Drops by a tree of dicts over the texts themselves; only the order of lines with equal counts is the operator's."""
    from spanloom.llm import lines as L
    from spanloom.llm.queries import op4_line_templates
    from spanloom.llm.tokens import text_bytes

    found = collections.defaultdict(set)
    for r in rows(spark, "documents"):
        for line in (r.text or "").split("\n"):
            dark = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(dark) >= L.LEAST_TOKENS or sum(len(w.encode()) for w in dark) >= L.LEAST_BYTES:
                masked = tuple(L.FIELD if len(dark) >= L.LEAST_TOKENS and re.search("[0-9]", w) else w for w in dark)
                found[masked].add(r.doc_id)

    def whole(tokens):
        return int(L.Lines.of(*text_bytes(pa.array([" ".join("7" if t == L.FIELD else t for t in tokens)]))).whole.view(np.int64)[0])

    gone = {t for t, d in found.items() if len(d) >= 3}
    leaves = collections.defaultdict(list)
    for t in found:
        if len(t) >= L.LEAST_TOKENS:
            leaves[len(t), t[: L.DEPTH]].append(t)
    for leaf in leaves.values():
        made: list[list[str]] = []
        members: list[list[tuple]] = []
        for t in sorted(leaf, key=lambda t: (-len(found[t]), whole(t))) if len(leaf) > 1 else []:
            same = [sum(a == b for a, b in zip(m, t, strict=True)) for m in made]
            k = max(range(len(made)), key=lambda k: (same[k], -k), default=-1)
            if k < 0 or same[k] < L.SIMILAR * len(t):
                made.append(list(t))
                members.append([t])
            else:
                made[k] = [a if a == b else L.FIELD for a, b in zip(made[k], t, strict=True)]
                members[k].append(t)
        for own in members:
            if len(own) > 1 and len(set().union(*(found[t] for t in own))) >= 3:
                gone.update(own)

    def kept(text):
        def recurs(line):
            dark = re.findall(r"[^\x20\x09-\x0D]+", line)
            return tuple(L.FIELD if len(dark) >= L.LEAST_TOKENS and re.search("[0-9]", w) else w for w in dark) in gone

        own = text.split("\n")
        stay = [x for x in own if not recurs(x)]
        return len(own), len(own) - len(stay), "\n".join(stay)

    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in op4_line_templates(spark, SF).collect()}
    assert got == {r.doc_id: kept(r.text) for r in rows(spark, "documents")}


def test_language_query_is_right_on_what_it_did_not_see(spark):
    from spanloom.llm.queries import op3_language_id

    lang = {r.doc_id: r.lang for r in rows(spark, "documents")}
    held = [r for r in op3_language_id(spark, SF).collect() if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_neighbour_query_against_all_pairs(spark):
    from spanloom.llm.queries import op5_nearest_neighbours

    v = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows(spark, "embeddings")}
    got = collections.defaultdict(list)
    for r in op5_nearest_neighbours(spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in v if i % 20 == 0}
    hits = 0
    for i, found in got.items():
        best = sorted((-float(v[j] @ v[i]), j) for j in v if j != i)[:20]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21)) and all(math.isclose(s, float(v[j] @ v[i]), rel_tol=1e-9) for _, j, s in found)
        hits += len({j for _, j in best} & {j for _, j, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_surrogate_query_changes_entities_only(spark):
    """Words that stay are the same, in order; what differs holds a digit, an @ or follows a title or the name of a secret."""
    from spanloom.llm.queries import op7_surrogates

    old = {r.doc_id: r.text for r in rows(spark, "documents")}
    for r in op7_surrogates(spark, SF).collect():
        a, b = old[r.doc_id].split(" "), r.text.split(" ")
        assert len(a) == len(b) and (a == b) == (r.n_entities == 0)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            assert x == y or re.search(r"[0-9@=]", x) or re.search(r"^\W*(Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b", " ".join(a[max(0, k - 2) : k])), (x, y)
