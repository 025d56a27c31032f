"""Spark reports over incident, census, shooting, police-death and poll tables.

Every operator takes a DataFrame plus column names and gives back a DataFrame.
Nothing here creates a session, collects rows, caches or draws; the caller
decides when to run a plan and where its result goes.
"""
