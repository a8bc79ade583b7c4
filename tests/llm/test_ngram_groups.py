"""Large groups of near copies: rows dealt out follow the group's size, and no link is lost."""

import numpy as np

from test_llm_models import brute_components, docs_of

from sqlscope.llm import ngram_join


def group(n):
    """Copies of one text with one to seven words changed, of which those with more than three link with nothing, and longer and shorter copies."""
    rng = np.random.default_rng(n)
    base = [f"b{k}" for k in range(200)]
    texts = [" ".join(base)]
    for k in range(n):
        near = base.copy()
        if k % 4:
            for at in rng.choice(40, 1 + k % 7, replace=False):
                near[5 * int(at)] = f"n{k}.{at}"
        elif k % 8:
            near = near[int(rng.integers(15, 30)) :]
        else:
            near += [f"e{k}.{j}" for j in range(int(rng.integers(20, 40)))]
        texts.append(" ".join(near))
    return texts


def test_rows_dealt_follow_the_size_of_a_group(spark, monkeypatch):
    dealt, settle = [], ngram_join._Join.settle

    def counted(self, cells):
        dealt[-1] += cells.count()
        settle(self, cells)

    monkeypatch.setattr(ngram_join._Join, "settle", counted)
    for n in (120, 480):
        dealt.append(0)
        texts = group(n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs_of(spark, texts), block=16).collect()}
        want = brute_components(texts, 4, 85)
        assert [got[k] for k in range(len(texts))] == want
        assert 0.3 * n < sum(c == 0 for _, c in want) < 0.8 * n
    assert dealt[1] < 6 * dealt[0], dealt
