from .files import (load_model, save_model, write_answers, write_label_map, write_predictions,
                    write_split)

__all__ = ["write_label_map", "write_split", "write_predictions", "write_answers", "save_model",
           "load_model"]
