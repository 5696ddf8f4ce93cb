"""Candidates against their SQL where the last digit of a box decides."""

import duckdb

from cadenza.plans import catalogue

#: 7 of a slanting box of 20; 8.5 of one of 64, half of a sixth place.
MASKS = {
    0: ".......#..##..#. .#.###...#..#.#. ..#.#....##....# ......##.....### #...##......##.. ....#..#....##.. #.......#..#.#.. ....#.....#..... ..#.#...#...#.#. #.#.##..#....#.. .#.#..##.....#.# ..#......#...... ....#.#.#....... ...#.#.#..#..... ..##.##..##.#... ....#...#.##.#..",
    1: ".#...#....##..#. ....#.#.#.#.#.#. ..#.....#..#...# ##..##..##.#.... ......##.#.#.... ..#.#.##......#. ..##.#..##....#. #.##.#.......#.. .#..........###. .##.#.#.##.....# .#####....#..#.# ..##....#..#..#. #....#.........# ..#.##..#...#.#. .##...#...##.... #..###.#....#.#.",
}


def test_fill_is_exact_at_its_bound(spark, tmp_path):
    duck = duckdb.connect()
    duck.sql("CREATE TABLE e (vec_id BIGINT, label BIGINT, embedding FLOAT[])")
    for frame, mask in MASKS.items():
        rows = mask.split()
        for k in range(4):
            duck.execute("INSERT INTO e VALUES (?, 0, ?)", [4 * frame + k, [float(c == "#") for r in rows[4 * k : 4 * k + 4] for c in r]])
    duck.sql(f"COPY e TO '{tmp_path}/embeddings.parquet'")
    duck.sql("ALTER TABLE e RENAME TO embeddings")
    found = catalogue.queries()["component_candidates"](spark, str(tmp_path))
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in found.columns)} FROM ({catalogue.oracle_sql()['component_candidates']})").fetchall()
    got = found.collect()
    assert sorted(map(tuple, got)) == sorted(want)
    slanting = {(r.frame, r.label): r for r in got}
    assert slanting[0, 51539607562].fill == 0.35 and slanting[0, 51539607562].accepted
    assert slanting[1, 8589934601].fill == 0.132813
