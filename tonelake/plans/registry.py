"""All registered queries of the library by name, with their SQL statements."""

from __future__ import annotations

from tonelake.plans import bands, choices, kernels, muxing, packets, reader, samples

FLAGSHIP = "toc_mode_mix"
QUERIES = packets.QUERIES | samples.QUERIES | kernels.QUERIES | reader.QUERIES | bands.QUERIES | muxing.QUERIES | choices.QUERIES
ORACLES = packets.ORACLES | samples.ORACLES | kernels.ORACLES | reader.ORACLES | bands.ORACLES | muxing.ORACLES | choices.ORACLES
