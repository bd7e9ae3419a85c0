"""Compare Arrow column types of every query with its DuckDB oracle.

Usage: python tests/type_check.py [sf_dir]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import duck  # noqa: E402


def norm(t) -> str:
    t = str(t)
    for a, b in (("large_string", "string"), ("string_view", "string"), ("large_list", "list"),
                 ("list<l: ", "list<element: ")):
        t = t.replace(a, b)
    return t


def main(sf: str) -> int:
    from adlens.session import local_session
    import __spark_entry__ as E
    spark = local_session()
    con = duck(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for k in q:
        if k not in o:
            continue
        st = {f.name: norm(f.type) for f in q[k](spark, sf).toArrow().schema}
        dt = {f.name: norm(f.type) for f in con.execute(o[k]).fetch_arrow_table().schema}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            bad += 1
        print(k, "OK" if not diff else diff, flush=True)
    print("type mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001") else 0)
