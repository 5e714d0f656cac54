"""All operators; importing the package fills the registry."""

from tabloom.operators import (  # noqa: F401
    bayes,
    boosting,
    decompose,
    discriminant,
    eliminate,
    ensemble,
    generate,
    linear,
    neighbors,
    prepare,
    regress,
    scale,
    select,
    trees,
)
