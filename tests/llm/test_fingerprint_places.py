import random

from millrace.llm import fingerprints as fp


def paragraph(rng, words=40):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(words)) + "."


def test_leaves_do_not_depend_on_the_place():
    """A paragraph was cut into other leaves beyond character 256 than before it."""
    rng = random.Random(1)
    text = paragraph(rng, 100)
    heading = "A heading of some length. " * 12
    leaves = lambda t: fp.read([fp.fingerprint(t)])[0].digest[2].tolist()
    assert leaves(text) == leaves(f"{heading}\n\n{text}")[-len(leaves(text)) :]
    a, b = fp.fingerprint(text), fp.fingerprint(f"{heading}\n\n{text}")
    assert fp.likeness(a, b) > 0.97 * 2 * len(text) / (2 * len(text) + len(heading))


def test_an_inserted_paragraph_leaves_the_others_alone():
    rng = random.Random(2)
    p = [paragraph(rng) for _ in range(6)]
    whole = lambda *sections: fp.fingerprint("\n\n".join("\n".join(s) for s in sections))
    a = whole(p[:3], p[3:])
    new = paragraph(rng)
    assert fp.edits(a, whole([p[0], new, p[1], p[2]], p[3:])) == [(0, 1)]
    assert fp.edits(a, whole([new], p[:3], p[3:])) == [(0, 0)]
    assert fp.edits(a, whole(p[:3], [new], p[3:])) == [(1, 0)]
    assert fp.edits(a, whole(p[:3], [p[3], p[5]])) == [(1, 1)]
    assert fp.edits(a, whole(p[:3], [p[3], new, p[5]])) == [(1, 1)]
    # the last paragraph gains a line break as well
    assert fp.edits(a, whole(p[:3], [*p[3:], new])) == [(1, 2)]
    assert fp.edits(a, a) == []
