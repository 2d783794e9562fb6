"""The page parser on pages that nothing closes, and the labeller's passes against plain loops."""

import time

import numpy as np
import pytest

from lectern.llm import html_text as H


@pytest.mark.parametrize("unit", ["<object>", "<svg><p>", "<div><p>x", "<li>", "</zz>", "<template>", "<math><math></math>", "<b>x</i>", "<!--", "<svg>"])
def test_a_megabyte_of_open_elements_takes_no_longer_than_its_length(unit):
    took = []
    for size in (250_000, 1_000_000):
        page = unit * (size // len(unit))
        began = time.process_time()
        H.blocks(page)
        took.append(time.process_time() - began)
    # In proportion it is 4 times as long; a square would be 16 times.
    assert took[1] < 10 * took[0] + 0.5


def test_hidden_elements_end_where_they_are_closed():
    said = lambda page: [b.text for b in H.blocks(page)]
    assert said("<p>a<svg><svg>b</svg>c</svg>d") == ["ad"]
    assert said("a<object>b<object>c</object>d") == ["abd"] and said("a<object>b<object>c</object>d</object>e") == ["ae"]
    assert said("</svg></svg>a<svg>b</svg>c</svg>d") == ["ac", "d"]
    assert said("<svg>a<p>b<svg>c</svg>d<svg/>e") == ["bde"]
    assert said("a<template>b<template>c</template>d") == ["a"]


def test_paths_are_the_names_around_a_block():
    found = H.blocks("<div class='a_bc nav'><p>x<ul><li>y<li><b>z</b></ul></div>end")
    assert [(list(b.path), b.text) for b in found] == [
        (["div", ".bc", ".nav", "p"], "x"), (["div", ".bc", ".nav", "p", "ul", "li"], "y"), (["div", ".bc", ".nav", "p", "ul", "li", "b"], "z"), ([], "end"),
    ]
    assert [len(b.path) for b in found] == [4, 6, 7, 0]
    deep = H.blocks("<div>" * 50_000 + "x")[0]
    assert len(deep.path) == 50_000 and len(deep.path.hashes) == 1 and H.described([deep], {})[0][0].size <= 2


def pages_of(seed, lengths):
    r = np.random.default_rng(seed)
    return [([r.choice(H.PATHS, 3, replace=False) for _ in range(n)], r.random((n, H.WORDS)).astype(np.float32), r.random((n, 7)).astype(np.float32)) for n in lengths]


def plain_probabilities(model, page):
    """The labeller's pass, block by block and cell by cell."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    inputs = [np.concatenate([sum(w["path"][i] for i in p), words @ w["word"], rates]) for p, words, rates in zip(*page)]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def run(d, order):
        h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), {}
        for t in order:
            z = inputs[t] @ w[d + "x"] + h @ w[d + "h"] + w[d + "b"]
            i, f, o, u = (z[k * H.HIDDEN : (k + 1) * H.HIDDEN] for k in range(4))
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(u)
            h = sigmoid(o) * np.tanh(c)
            out[t] = h
        return out

    n = len(inputs)
    ahead, back = run("f", range(n)), run("b", range(n - 1, -1, -1))
    return [float(sigmoid(np.concatenate([ahead[t], back[t], inputs[t]]) @ w["out"] + w["bias"][0])) for t in range(n)]


def test_the_labeller_passes_over_pages_as_a_plain_loop_does():
    model, pages = H.Labeller(), pages_of(3, [1, 5, 0, 9])
    for page, got in zip(pages, model.probabilities(pages)):
        assert got == pytest.approx(plain_probabilities(model, page), abs=1e-4)


def test_gradients_are_what_small_steps_show():
    model, pages = H.Labeller(), pages_of(4, [4, 6])
    r = np.random.default_rng(1)

    def loss():
        x, mask = model._inputs(pages)
        return float((model._run(x, mask, "f") * weights).sum())

    x, mask = model._inputs(pages)
    weights = r.standard_normal((*mask.shape, H.HIDDEN)).astype(np.float32) * mask[:, :, None]
    keep, grads = [], {k: np.zeros_like(v) for k, v in model.w.items()}
    model._run(x, mask, "f", keep)
    model._back(x, mask, "f", keep, weights, grads)
    for name in ("fx", "fh", "fb"):
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in model.w[name].shape)
            before = model.w[name][at]
            model.w[name][at] = before + 0.01
            high = loss()
            model.w[name][at] = before - 0.01
            low = loss()
            model.w[name][at] = before
            assert grads[name][at] == pytest.approx((high - low) / 0.02, abs=2e-2, rel=2e-2)
