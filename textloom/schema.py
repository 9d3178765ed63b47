"""Schemas of the engine's tables."""

LABELLED_TEXT = "text string, spans array<struct<start:int,end:int,label:string>>, answer string"
