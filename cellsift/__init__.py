"""cellsift: curation of gridded and point-cloud field data on Spark.

Score boxes and points of large simulation archives by how informative they
are, draw samples, and shape the selection into training tables.  Everything is
a DataFrame in and a DataFrame out.
"""

from cellsift.params import CurationParams
from cellsift.session import build_session

__all__ = ["CurationParams", "build_session"]
