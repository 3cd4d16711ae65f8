import random

import pytest

#: Columns that operators use inside, as extra columns of the input: they must not clash.
EXTRA = "fp long, n int, head long, d string, t string, row int, left string, part int, full string, keep_id long, spans string, kept boolean, text_sha256 string"


@pytest.fixture
def docs(spark):
    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else "")
        width = schema.count(",") + 1
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *[None] * (width - 5)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, blanks and one long one."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustnr") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    shared, long = prose(90), prose(3000)
    out = [prose(r.randint(1, 200)) for _ in range(25)]
    out += [out[0], out[0].replace(" ", "\n\t "), out[1], shared + " " + prose(50), prose(40) + "\n" + shared, prose(10) + shared + shared]
    edited = out[5].split(" ")
    edited[len(edited) // 2] = "changed"
    out += [" ".join(edited), long, long[:-1] + "x", None, "", None, " \n\t", "one", "É, ß — 日本語 😀 naïve", "ab" * 600, "the the the the the the the the the the the the"]
    return list(enumerate(out))
