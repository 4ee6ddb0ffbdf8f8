"""docloom: Spark-native structure queries over long documents.

Everything is expressed as DataFrame / SQL plans keyed by ``doc_id``; see README.md
for the package layout.
"""

__version__ = "0.1.0"
