"""greenwake: golf-course terrain and hole similarity as Spark DataFrame plans."""

__version__ = "0.1.0"
