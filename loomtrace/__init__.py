"""loomtrace: a PySpark-native analytics engine for object-track data.

``sources`` reads and writes tables, ``functions`` holds column expressions, ``operators`` holds
DataFrame -> DataFrame operators, ``plans`` composes them into registered queries and
``streaming`` has the Structured Streaming counterparts.
"""
