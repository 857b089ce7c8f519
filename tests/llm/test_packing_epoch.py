"""What an epoch tells of itself is worked out once: the bound, and the bins of the packing it began with."""

from brindle.llm import packing


def test_an_epoch_tells_its_bound_and_its_first_bins(monkeypatch):
    lengths, calls = sorted([600 + (i * 37) % 400 for i in range(200)], reverse=True), []
    least, first = packing.least_bins(lengths, 2048), len(packing.first_packing(range(len(lengths)), lengths, 2048))
    bound = packing.least_bins
    monkeypatch.setattr(packing, "least_bins", lambda *a: calls.append(1) or bound(*a))
    begun = packing.evolve(lengths, 2048, 3)
    assert (begun.least, begun.first, len(calls)) == (least, first, 1)
    assert packing.evolve(lengths, 2048, 3, begun.people).first is None
    one = packing.evolve([7], 2048, 1)
    assert (one.least, one.first) == (1, 1) and packing.evolve([], 2048, 1).least == 0
