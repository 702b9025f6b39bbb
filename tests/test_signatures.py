"""Signature files and images of a file of reads."""

import numpy as np
import pytest

from strandloom.plans import commands
from strandloom.plans.signatures import run_signature
from strandloom.sources import signature_file
from strandloom.spec import FilterSpec

# FIXTURES.md, part 3
READS = [
    ("r1", "ACGTACGTAC", "IIIIIIIIII"),
    ("r2", "AAAAANNGGC", "!!!!!IIIII"),
    ("r3", "GGGGGCCCCC", "5555555555"),
    ("r4", "ACGTN", "I!I!I"),
    ("r5", "TTTTTTTTTTTT", "IIIIIIIIII##"),
    ("r6", "acgtRACGTA", "IIIII55555"),
]
COUNTS = {(0, 0): 4, (0, 1): 2, (0, 2): 4, (0, 3): 5, (1, 0): 5, (2, 3): 4, (3, 0): 4, (3, 1): 3, (3, 3): 11}
QUALITY = {(0, 0): 20, (0, 1): 30, (0, 2): 30, (0, 3): 24, (1, 0): 32, (2, 3): 30, (3, 0): 0, (3, 1): 33, (3, 3): 34}


@pytest.fixture
def reads(tmp_path):
    path = tmp_path / "reads.fq"
    path.write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in READS))
    return str(path)


def image(path):
    head, side, most, data = open(path, "rb").read().split(b"\n", 3)
    n = int(side.split()[0])
    assert (head, side, most) == (b"P5", b"%d %d" % (n, n), b"255")
    return np.frombuffer(data, np.uint8).reshape(n, n)


def square(cells):
    out = np.zeros((4, 4), int)
    for at, n in cells.items():
        out[at] = n
    return out


def test_signature_and_images(spark, reads, tmp_path):
    got = run_signature(spark, reads, str(tmp_path / "out"), 2)
    assert [f.rpartition("/")[2] for f in got.files] == ["reads.fq_k=2.gs", "reads.fq_k=2_FG.pgm", "reads.fq_k=2_QQ.pgm"]
    assert (got.words, got.difference) == (42, None)
    name, k, words, counts = signature_file.decode(open(got.files[0], "rb").read())
    assert (name, k, words) == ("reads.fq", 2, 42) and np.array_equal(counts, square(COUNTS))
    large = lambda x: np.kron(x, np.ones((32, 32), int))
    assert np.array_equal(image(got.files[1]), large((square(COUNTS) * (128.0 / (42 / 16))).astype(int) % 256))
    assert np.array_equal(image(got.files[2]), large((square(QUALITY) * (256.0 / 62)).astype(int) % 256))


def test_difference_to_a_signature(spark, reads, tmp_path):
    out = str(tmp_path / "out")
    own = run_signature(spark, reads, out, 2).files[0]
    same = run_signature(spark, reads, out, 2, own)
    assert same.difference == {"highest": 0, "lowest": 0, "mean": 0.0, "stddev": 0.0}
    # The header's number of words counts, also where it isn't the sum of the cells.
    other = tmp_path / "other.gs"
    data = bytearray(signature_file.encode("other", 2, [3, 1], [3, 1], [5, 3]))
    data[192:196] = (16).to_bytes(4, "little")
    other.write_bytes(data)
    got = run_signature(spark, reads, out, 2, str(other))
    dif = np.trunc(square(COUNTS) * (128.0 / (42 / 16)) - square({(3, 3): 5, (1, 1): 3}) * 128.0).astype(int)
    assert (got.difference["highest"], got.difference["lowest"]) == (dif.max(), dif.min())
    assert got.difference["mean"] == pytest.approx(dif.mean(), abs=1e-6) and got.difference["stddev"] == pytest.approx(dif.std(), abs=1e-6)
    assert np.array_equal(image(got.files[3])[::32, ::32], np.minimum(abs(dif), 255))


def test_only_reads_that_pass(spark, reads, tmp_path):
    assert run_signature(spark, reads, str(tmp_path), 2, spec=FilterSpec(min_length=12)).words == 11
    with pytest.raises(ValueError):
        run_signature(spark, reads, str(tmp_path), 2, spec=FilterSpec(min_length=99))
    with pytest.raises(ValueError):
        run_signature(spark, reads, str(tmp_path), 13)


def test_command_line():
    args = commands.parser().parse_args(["signature", "-f", "x.fq", "-k", "5", "--gs-filename", "y.gs", "--max-N", "0"])
    assert (args.k, args.gs_filename, commands.specs(args)[0].max_n) == (5, "y.gs", 0)
