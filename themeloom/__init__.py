"""themeloom: organise large collections of short and long free text with Spark DataFrames.

Records are validated, tied to versioned questions, cut into segments, embedded, given topics
from nearest-neighbour evidence, and rolled up into themes.  Every public function takes and
returns DataFrames; Catalyst plans the rest.
"""

__version__ = "0.1.0"
