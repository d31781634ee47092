"""heliogale: gridded climate and energy-zone analytics as Spark DataFrame operators."""
