"""Evidence-bounded dependency analytics on Spark."""
from .bundle import Bundle, BundleError, bundle_digest, doctor
from .operators.search import find
from .operators.traversal import boundaries, lineage_edges, packed_paths, reach, shortest_paths, traverse
from .operators.validation import messages
from .records import Records
from .tools import ANSWERED, TOOLS, UNKNOWN, Graph, call

__version__ = "0.2.0"
__all__ = ["ANSWERED", "Bundle", "BundleError", "Graph", "Records", "TOOLS", "UNKNOWN", "boundaries", "bundle_digest", "call", "doctor", "find", "lineage_edges", "messages", "packed_paths", "reach",
           "shortest_paths", "traverse"]
