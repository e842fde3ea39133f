"""siftline: a Spark-native content scanner.

Files become a relation of numbered lines, lines meet data-driven rule packs,
and detections become reports, all as DataFrame plans that Catalyst optimises.
"""

__version__ = "0.1.0"
