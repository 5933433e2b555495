"""Front ends that turn program text into DataFrame plans."""
