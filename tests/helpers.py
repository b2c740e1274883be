"""What several test modules share; nothing is imported from a conftest."""


def as_dicts(df, *keys):
    rows = [row.asDict() for row in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else rows
