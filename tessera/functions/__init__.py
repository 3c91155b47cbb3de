"""Column expressions and fixed coefficient tables shared by the operators."""

from tessera.functions.coefficients import (
    STRASSEN_PRODUCTS, STRASSEN_COMBINE, left_terms, right_terms, combine_terms,
    coefficient_frames,
)
from tessera.functions.expressions import (
    quadrant, local_index, quadrant_offset, quadrant_label, product_label,
    child_path, path_m, path_parent, halve, pow2, padded_size, signed_array,
)
