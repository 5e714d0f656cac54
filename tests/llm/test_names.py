import numpy as np
import pytest

from tabloom.llm import quality_classifier
from tabloom.llm.jaccard_join import one_of_each
from tabloom.llm.line_dedup import remove_boilerplate
from tabloom.llm.mixing import mix

ODD = ("my col", "a.b", "back`tick")


def scored(docs):
    return quality_classifier.score(docs, quality_classifier.fit_rows([], np.zeros(0, dtype=bool)))


@pytest.mark.parametrize("operator", [one_of_each, remove_boilerplate, mix, scored])
def test_columns_of_any_name_pass(odd_docs, operator):
    out = operator(odd_docs)
    assert set(ODD) <= set(out.columns) and all(r[n] == "x" for r in out.collect() for n in ODD)
