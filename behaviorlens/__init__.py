"""behaviorlens: behaviour analytics as Spark DataFrame operators."""
