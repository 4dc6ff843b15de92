"""Tabulon: data-science operators expressed as Spark DataFrame plans."""
