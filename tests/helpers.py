"""Row makers shared by the tests."""


def closes(values, symbol="A", start=0):
    return [{"symbol": symbol, "date": start + i, "close": v} for i, v in enumerate(values)]
