"""Trace analytics on Spark: labelled events, decision graphs, mining, retrieval and audited statistics as DataFrame programs."""
