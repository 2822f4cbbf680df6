"""Operators for preparing training corpora. Nothing else in the package imports this subpackage."""

import pyarrow as pa

# Workers outlive their tasks; with the system's allocator, a batch's memory goes back when it is done with.
pa.set_memory_pool(pa.system_memory_pool())
