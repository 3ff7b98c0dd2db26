"""Rows of a Spark query and of its SQL, columns by name and rows sorted."""


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(str(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order) for r in rows), key=repr)


def same(df, relation):
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(relation.columns, relation.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y and not all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1, abs(u))) for u, v in zip(x, y, strict=True))]
    assert not wrong, (len(wrong), wrong[:3])
