"""Object features of masks whose last bits once decided a bin or a rounded value, against exact arithmetic and the SQL."""

import duckdb
import numpy as np
import pytest

from lumenframe.functions.descriptors import DESCRIPTORS, Image
from lumenframe.plans.queries import ORACLE

EVEN = ".....##. #####.#. #.#...#. ....#.## .#.#.... ..#..##. .#.##... ##...##."  # two objects of 13 pixels
HALF = ".#..#... #...#### ..###.## .###.##. .###.### ###.###. #######. ###.###."  # the variance of the distances is 9.5890625


def plane(text, inverse):
    p = np.array([[c == "#" for c in row] for row in text.split()], float)
    return 1 - p if inverse else p


@pytest.mark.parametrize("name, inverse", [("Otsu Object Features", False), ("Inverse-Otsu Object Features", True)])
def test_objects_at_one_distance_share_a_bin(name, inverse):
    even, half = (DESCRIPTORS[name].run(Image(plane(t, inverse))) for t in (EVEN, HALF))
    assert even[17] == half[17] == 2 and even[10] == even[13]
    assert even[18:28].tolist() == [2] + [0] * 9
    assert half[32] == 9.5890625


@pytest.mark.parametrize("query, name, inverse", [("F12_objects", "Otsu Object Features", False), ("F13_inverse_objects", "Inverse-Otsu Object Features", True)])
def test_object_features_agree_with_sql(query, name, inverse):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding FLOAT[])")
    planes = [plane(t, inverse) for t in (EVEN, HALF)]
    con.executemany("INSERT INTO embeddings VALUES (?, 0, ?)", [(i, p.ravel().tolist()) for i, p in enumerate(planes)])
    sql = {(i, k): v for i, k, v in con.sql(ORACLE[query]).fetchall()}
    for i, p in enumerate(planes):
        got = DESCRIPTORS[name].run(Image(p))
        assert [got[k] for k in range(18, 28)] == [sql[i, k] for k in range(18, 28)]
        assert got == pytest.approx([sql[i, k] for k in range(34)], abs=1.1e-6)
